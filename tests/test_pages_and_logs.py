"""Layout, geometry, logs, tracking and streams on small cases with known answers."""

import datetime
import time

from pyspark.sql import functions as F

from sourcemark.operators import access as ac
from sourcemark.operators import assembly as asm
from sourcemark.operators import geometry as gm
from sourcemark.operators import layout as ly
from sourcemark.operators import lifecycle as lc
from sourcemark.operators import sections as sec
from sourcemark.operators import worktrack as wt
from sourcemark.sources import files as fl
from sourcemark.streaming import feeds

BOX = "array<struct<x0:double,x1:double>>"


def gutter(spark, boxes, width=595.0):
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in boxes],)], f"w {BOX}")
    (row,) = df.select(ly.gutter_of(F.col("w"), F.lit(width)).alias("g")).collect()
    return row.g and (row.g.left, row.g.right)


def test_gutters(spark):
    assert gutter(spark, [(50, 150), (300, 450), (50, 140), (300, 430)]) == (150, 300)
    assert gutter(spark, [(50, 150), (165, 300)] * 2) is None
    assert gutter(spark, [(50, 100)] * 15 + [(500, 540)]) is None
    assert gutter(spark, [(50, 250), (550, 590)] * 4) is None
    assert gutter(spark, [(50, 200), (330, 540)] * 4) == (200, 330)
    assert gutter(spark, [(50, 200)]) is None


def test_rows_hang_on_their_first_word(spark):
    words = spark.createDataFrame([(1, 1, t, n) for n, t in enumerate([100.0, 102.5, 104.9, 105.5, 120.0])], "doc_id int, page int, top double, n int")
    rows = {r.n: r.row_no for r in ly.assign_rows(words).collect()}
    assert rows == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def merged(spark, bands):
    df = spark.createDataFrame([(bands,)], f"b array<{ly._BAND}>")
    (row,) = df.select(ly.merge_bands(F.col("b")).alias("m")).collect()
    return [(b.top, b.bottom, b.gutter and (b.gutter.left, b.gutter.right)) for b in row.m]


def test_columned_bands_merge(spark):
    assert merged(spark, [(0.0, 100.0, (150.0, 300.0)), (100.0, 200.0, (155.0, 295.0))]) == [(0.0, 200.0, (155.0, 295.0))]
    assert len(merged(spark, [(0.0, 1.0, (100.0, 200.0)), (1.0, 2.0, (350.0, 450.0))])) == 2
    assert len(merged(spark, [(0.0, 1.0, (100.0, 200.0)), (1.0, 2.0, None), (2.0, 3.0, (100.0, 200.0))])) == 3
    # The overlap shrinks as it goes: the third meets the second but not what is left of it.
    assert len(merged(spark, [(0.0, 1.0, (100.0, 200.0)), (1.0, 2.0, (190.0, 300.0)), (2.0, 3.0, (250.0, 300.0))])) == 2


RUNS = f"doc_id int, page int, char_start int, top double, bottom double, x {BOX}"


def test_remap_splits_where_a_character_went(spark):
    boxes = [(float(i), i + 0.5) for i in range(3)]
    runs = spark.createDataFrame([(1, 1, 0, 0.0, 10.0, boxes), (2, 1, 0, 0.0, 10.0, boxes[:2])], RUNS)
    removed = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id int, page int, idx int")
    got = sorted((r.doc_id, r.char_start, len(r.x)) for r in gm.remap_runs(runs, removed).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 1)]
    assert {r.char_start for r in gm.shift_runs(runs, F.lit(10)).collect()} == {10}


def test_boxes_do_not_depend_on_the_bin_width(spark):
    runs = spark.createDataFrame([(1, 1, s, 0.0, 10.0, [(float(i), i + 1.0) for i in range(n)]) for s, n in [(0, 7), (8, 20), (40, 90)]], RUNS)
    spans = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 3), (5, 12), (3, 129), (50, 50), (7, 8)])], "doc_id int, ref_no int, char_start int, char_end int")
    wide = sorted(map(tuple, gm.citation_boxes(spans, runs).collect()))
    assert wide == sorted(map(tuple, gm.citation_boxes(spans, runs, 4).collect()))
    assert [(w[1], w[3]) for w in wide] == [(0, 0), (1, 5), (1, 8), (2, 3), (2, 8), (2, 40)]


def test_assembly_normalises_before_it_measures(spark):
    pages = spark.createDataFrame([(1, 2, "second page has enough text"), (1, 1, "Å\x00b first page has some text")], "doc_id int, page int, text string")
    (row,) = asm.assemble_documents(pages).collect()
    assert row.text.startswith("Åb first")
    for page in row.pages:
        assert "\n\n" not in row.text[page.char_start : page.char_end]
    assert row.text[row.pages[1].char_start : row.pages[1].char_end] == "second page has enough text"


def test_thai_resume_sections(spark):
    text = "สมชาย ใจดี\nวิศวกรอาวุโส\nประสบการณ์ทำงาน\nบริษัท เอซีเอ็มอี — วิศวกร (ม.ค. 2564 - มี.ค. 2567)\nทักษะ\nPython, SQL · Go\nการศึกษา\nจุฬา — วศ.บ. (2558 - 2562)"
    (row,) = sec.raw_profile(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.full_name.value, row.seniority) == ("สมชาย ใจดี", "senior")
    assert [s.name for s in row.skills] == ["Python", "SQL", "Go"]
    assert (row.experiences[0].title, row.experiences[0].start, row.experiences[0].end) == ("วิศวกร", "ม.ค. 2564", "มี.ค. 2567")
    assert (row.education[0].institution, row.education[0].credential) == ("จุฬา", "วศ.บ.")


def test_replay(spark):
    log = [(1, 0, None, "applied"), (1, 1, "applied", "screening"), (1, 2, "screening", "screened"), (2, 0, None, "applied"), (2, 1, "screened", "shortlisted"), (3, 0, "applied", "screening")]
    df = spark.createDataFrame(log, "application_id int, position int, from_state string, to_state string")
    assert {r.application_id: r.replayed_state for r in lc.replay(df).collect()} == {1: "screened", 2: None, 3: None}


def test_long_logs_are_folded_in_blocks(spark):
    cycle = ["screening", "screened", "rejected", "shortlisted"]
    rows = [(a, i, cycle[(i + a) % 4] if i != 900 else "withdrawn", "applicant" if i == 900 else "job_owner" if (i + a) % 4 > 1 else "system", None, "s") for a in (1, 2) for i in range(1000)]
    requests = spark.createDataFrame(rows, "application_id int, at int, to_state string, mover string, reason string, screening_id string")
    apps = spark.createDataFrame([(1, "applied", 0), (2, "applied", 5)], "application_id int, state string, last_position long")
    small = lc.apply_moves(requests, apps, ["at"], block=3)
    large = lc.apply_moves(requests, apps, ["at"], block=4096)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))
    for app, first in ((1, 1), (2, 6)):
        mine = sorted((r for r in small.collect() if r.application_id == app), key=lambda r: r.at)
        assert [r.position for r in mine if r.allowed] == list(range(first, first + sum(r.allowed for r in mine)))
        assert not any(r.allowed for r in mine if r.at > 900)
        for a, b in zip(mine, mine[1:]):
            assert b.from_state == (a.to_state if a.allowed else a.from_state)


def test_publication_table_is_complete(spark):
    statuses = ["draft", "published", "closed"]
    rows = [(s, t, p, None) for s in statuses for t in statuses for p in ("owner", "admin", None)]
    df = spark.createDataFrame(rows, "status string, target string, publisher string, published_at timestamp")
    got = {(r.status, r.target, r.publisher): r.outcome for r in ac.plan_publication(df, F.current_timestamp()).collect()}
    assert got[("draft", "published", "owner")] == "only_admin_publishes"
    assert got[("draft", "published", "admin")] == "moved"
    assert got[("published", "draft", "owner")] == "moved"
    assert all(got[(s, s, "owner")] == "unchanged" for s in statuses)
    assert all(v == "not_yours" for k, v in got.items() if k[2] is None)


def test_retry_policy(spark):
    rows = [("LLMUnavailableError", "down", n) for n in (1, 2, 3)] + [("CorruptDocumentError", "bad", 1), ("RuntimeError", "secret", 1)]
    df = spark.createDataFrame(rows, "error_class string, message string, failed_attempts int")
    got = [(r.verdict, r.retry_after_seconds) for r in wt.decide_retry(df, base_seconds=5.0, max_attempts=3).collect()]
    assert got == [("retry", 5.0), ("retry", 10.0), ("exhausted", None), ("permanent", None), ("retry", 5.0)]
    assert "secret" not in " ".join(r.reason for r in wt.decide_retry(df).collect())


def test_strict_claims_refuse_what_does_not_fit(spark, tmp_path):
    (tmp_path / "claims.json").write_text('{"doc_id": 1, "quote": "q"}\n{"doc_id": "one", "quote": "q"}\n')
    df = fl.read_claims(spark, str(tmp_path), "doc_id int, quote string")
    try:
        df.collect()
    except Exception:
        return
    raise AssertionError("a malformed line was accepted")


def test_stalled_claims_are_reported_by_the_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    def batch(name, rows):
        spark.createDataFrame([(i, start + datetime.timedelta(seconds=s), st) for i, s, st in rows], "id long, at timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    batch("a", [(1, 0, "processing"), (2, 0, "processing"), (3, 5, "pending")])
    schema = "id long, at timestamp, status string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    def drain():
        feeds.run_to_table(feeds.stream_stalled(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    drain()
    time.sleep(1)
    batch("b", [(2, 600, "completed"), (9, 5000, "pending")])
    drain()
    time.sleep(1)
    batch("c", [(9, 6000, "pending")])
    drain()
    got = spark.read.schema("id long, claimed_at timestamp").parquet(str(tmp_path / "out")).collect()
    assert [(r.id, r.claimed_at) for r in got] == [(1, start)]


def test_boxes_are_cut_to_the_page_or_given_up(spark):
    from sourcemark.operators import layout

    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    rows = [
        (1, [(-5.0, -2.0, 50.0, 40.0), (50.0, 10.0, 130.0, 90.0)]),
        (2, [(0.0, 0.0, 50.0, 50.0), (110.0, 0.0, 130.0, 50.0)]),
    ]
    df = spark.createDataFrame(rows, f"n int, boxes array<{box}>").withColumn(
        "page", F.struct(*[F.lit(float(v)).alias(k) for k, v in (("left", 0), ("top", 0), ("right", 100), ("bottom", 80))])
    )
    got = {r.n: r.cut for r in df.select("n", layout.clamp(F.col("boxes"), F.col("page")).alias("cut")).collect()}
    assert [tuple(b) for b in got[1]] == [(0.0, 0.0, 50.0, 40.0), (50.0, 10.0, 100.0, 80.0)]
    assert got[2] is None
