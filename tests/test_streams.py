"""Timed streams over several micro-batches: order, silence, lateness, dropped state, replayed batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sourcemark.operators import lifecycle as lc
from sourcemark.operators import worktrack as wt
from sourcemark.streaming import feeds, timed

START = datetime.datetime(2024, 1, 1)
READING = "id long, at timestamp, tie long, status string, payload string"
REQUEST = (
    "application_id long, at timestamp, request_id long, to_state string, mover string, reason string, "
    "screening_id long, initial_state string, last_position long"
)
UPDATE = "id long, at timestamp, tie long, status string"


def moment(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def play(spark, tmp_path):
    """Runs batches of rows through a stream, one micro-batch each, and a closing row far in the future."""

    def run(schema, batches, stream, delay, closing=None):
        for rows in [*batches, *([[closing]] if closing else [])]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = feeds.read_arrivals(spark, str(tmp_path / "in"), schema).withWatermark("at", delay)
        out = stream(arrivals)
        feeds.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "progress"))
        return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))

    return run


def dealt(rows, at, spread, count, seed):
    """``rows`` in ``count`` batches by arrival, up to ``spread`` seconds after their moment."""
    rng = random.Random(seed)
    came = sorted((row[at] + datetime.timedelta(seconds=rng.random() * spread), n) for n, row in enumerate(rows))
    size = -(-len(rows) // count)
    batches = [[rows[n] for _, n in came[i : i + size]] for i in range(0, len(rows), size)]
    for batch in batches:
        rng.shuffle(batch)
    return batches


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_out_of_order_equal_the_batch(spark, play, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(160):
        to, mover = rng.choice([t[:0:-1] for t in lc.TRANSITIONS])
        rows.append((rng.randint(0, 5), moment(n * 10), n, to, mover, rng.choice([None, " ", "why"]), rng.choice([None, 7]), "applied", 3))
    far = (-1, moment(10**7), 0, None, None, None, None, "applied", 0)
    batches = dealt(rows, 1, 100, 4, seed)
    assert [r for b in batches for r in b] != rows
    got = play(REQUEST, batches, timed.stream_moves, "100 seconds", far)
    requests = spark.createDataFrame(rows, REQUEST)
    applications = spark.createDataFrame([(i, "applied", 3) for i in range(6)], "application_id long, state string, last_position long")
    want = lc.apply_moves(requests.drop("last_position", "initial_state"), applications, ["at", "request_id"])
    columns = ["application_id", "request_id", "from_state", "to_state", "allowed", "position"]
    assert sorted(map(str, got.where(~F.col("late")).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.where("late").count() == 0


def test_late_moves_come_out_and_change_nothing(play):
    def request(at, number, to):
        return (1, moment(at), number, to, "system", None, None, "applied", 0)

    batches = [
        [request(0, 1, "screening"), request(100, 2, "screened")],
        [request(500, 3, "screening")],
        [request(600, 6, "applied")],
        [request(50, 4, "applied"), request(700, 5, "screened")],
    ]
    got = play(REQUEST, batches, timed.stream_moves, "60 seconds", (-1, moment(10**7), 0, None, None, None, None, "applied", 0))
    rows = {r.request_id: (r.from_state, r.allowed, r.position, r.late) for r in got.collect()}
    assert rows == {
        1: ("applied", True, 1, False),
        2: ("screening", True, 2, False),
        3: ("screened", True, 3, False),
        4: (None, None, None, True),
        6: ("screening", True, 4, False),
        5: ("applied", False, None, False),
    }


def test_state_is_dropped_after_a_while(play):
    def request(at, number, initial):
        return (1, moment(at), number, "screening", "system", None, None, initial, number * 10)

    # The third request comes when nothing is held any more: the stored application it carries counts again.
    batches = [[request(0, 1, "applied"), request(10, 2, "applied")], [(2, moment(5000), 9, *request(0, 1, "applied")[3:])],
               [(2, moment(6000), 10, *request(0, 1, "applied")[3:])], [request(7000, 3, "screened")]]
    got = play(REQUEST, batches, lambda r: timed.stream_moves(r, linger=600), "60 seconds", (-1, moment(10**7), 0, None, None, None, None, "applied", 0))
    rows = {r.request_id: (r.from_state, r.allowed, r.position) for r in got.where("application_id = 1").collect()}
    assert rows == {1: ("applied", True, 11), 2: ("screening", False, None), 3: ("screened", True, 31)}


def test_a_silent_feed_closes_at_its_deadline(play):
    batches = [
        [(1, moment(0), 1, "pending", "a"), (2, moment(5), 2, "pending", "x")],
        [(2, moment(250), 3, "extracted", "y"), (3, moment(260), 4, "processing", "z")],
        [(4, moment(400), 5, None, None), (1, moment(100), 6, "processing", "b")],
        [(3, moment(300), 7, "processing", "z"), (1, moment(420), 8, "extracted", "late to the feed")],
    ]
    got = play(READING, batches, timed.stream_status_feed, "320 seconds", (-1, moment(10**7), 0, None, None))
    frames = {}
    for r in got.collect():
        frames.setdefault(r.id, []).append((r.seq, r.frame, r.payload))
    assert {k: sorted(v) for k, v in frames.items()} == {
        1: [(0, "status", "a"), (1, "status", "b"), (2, "timeout", "b")],
        2: [(0, "status", "x"), (1, "done", "y"), (1, "status", "y")],
        3: [(0, "status", "z"), (2, "timeout", "z")],
        4: [(0, "gone", None)],
    }


def test_feeds_closed_by_readings_equal_the_batch(spark, play):
    rng = random.Random(4)
    rows = []
    for n in range(150):
        status = rng.choice(["pending"] * 6 + ["processing"] * 6 + ["failed", None])
        rows.append((rng.randint(0, 9), moment(n * 4), n, status, rng.choice("ab") if status else None))
    got = play(READING, dealt(rows, 1, 40, 4, 4), lambda r: timed.stream_status_feed(r, silent=False), "40 seconds", (-1, moment(10**7), 0, None, None))
    seen = {}
    numbered = []
    for row in rows:
        numbered.append((*row, seen.setdefault(row[0], 0)))
        seen[row[0]] += 1
    want = wt.status_feed(spark.createDataFrame(numbered, READING + ", seq long").drop("tie"))
    columns = ["id", "seq", "payload", "frame"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_claims_are_judged_once_all_that_may_follow_is_in(play):
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), moment(rng.randint(0, 9000)), n, rng.choice(["processing", "extracted"])) for n in range(80)]
    rows.sort(key=lambda r: r[1])
    got = play(UPDATE, dealt(rows, 1, 300, 4, 9), timed.stream_stalled, "300 seconds", (-1, moment(10**7), 0, None))
    want = []
    for key in range(4):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key)
        for n, (at, _, status) in enumerate(own):
            if status == "processing" and (n + 1 == len(own) or own[n + 1][0] > at + datetime.timedelta(seconds=900)):
                want.append((key, at, False))
    assert sorted((r.id, r.claimed_at, r.late) for r in got.collect()) == sorted(want)
    assert want


def test_a_replayed_batch_of_uploads_adds_nothing(spark, tmp_path):
    schema = "upload_id long, owner_id string, content_hash string"
    first = spark.createDataFrame([(5, "o", "h"), (3, "o", "h"), (4, "p", "h")], schema)
    second = spark.createDataFrame([(1, "o", "h"), (6, "o", "i"), (7, "o", "i")], schema)
    store = str(tmp_path)

    def stored(what):
        return sorted(map(tuple, feeds.stored_uploads(spark, store, first, what).collect()))

    feeds.settle_uploads(first, 0, store)
    feeds.settle_uploads(second, 1, store)
    kept, answered = stored("kept"), stored("answered")
    assert kept == [(3, "o", "h", 0), (4, "p", "h", 0), (6, "o", "i", 1)]
    assert answered == [(1, "o", "h", 3, 1), (5, "o", "h", 3, 0), (7, "o", "i", 6, 1)]
    feeds.settle_uploads(second, 1, store)
    feeds.settle_uploads(first, 0, store)
    assert (stored("kept"), stored("answered")) == (kept, answered)


def test_uploads_of_a_restarted_stream(spark, tmp_path):
    schema = "upload_id long, owner_id string, content_hash string"
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    for n in range(3):
        rows = spark.createDataFrame([(10 * n + k, "o", f"h{(n + k) % 4}") for k in range(4)], schema)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.run_uploads(feeds.read_arrivals(spark, str(tmp_path / "in"), schema), store, progress)
    kept = feeds.stored_uploads(spark, store, rows).collect()
    assert sorted((r.upload_id, r.content_hash) for r in kept) == [(0, "h0"), (1, "h1"), (2, "h2"), (3, "h3")]
    assert feeds.stored_uploads(spark, store, rows, "answered").count() == 8
