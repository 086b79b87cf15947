"""Registered queries that run a stream over a table and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sourcemark.operators.ingest import content_hash
from sourcemark.plans import applications as ap
from sourcemark.plans import intake as ik
from sourcemark.plans.common import DataFrame, SparkSession, table
from sourcemark.session import settle, use_checkpoint_dir
from sourcemark.streaming import feeds, timed


def _shared_root(spark: SparkSession) -> str:
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run the stream to the end of its input; output and progress go to the shared folder."""
    root = f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    feeds.run_to_table(stream, f"{root}/out", f"{root}/progress")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


# Parts a table arrives in, a micro-batch each, and rows per file of a part, which are written side by side.
_FILES = 4
_FILE_ROWS = 50_000
_FAR = "timestamp'2035-01-01 00:00:00'"


def _arrivals(spark: SparkSession, rows: DataFrame, key: str, tie: str, delay: int) -> DataFrame:
    """``rows`` (with ``at``) as a stream of files out of order by up to ``delay`` seconds, in parts of a micro-batch each.

    All parts have the same number of files, empty ones among them, so a micro-batch never ends within a part.

    A last file holds one row of no other key far in the future, which moves the watermark past all others.
    """
    root = f"{_shared_root(spark)}/arrivals-{uuid.uuid4().hex}"
    jitter = F.make_dt_interval(secs=F.pmod(F.xxhash64(tie), F.lit(delay)))
    came = rows.withColumn("came", F.col("at") + jitter)
    low, high, count = came.agg(F.min(F.unix_micros("came")), F.max(F.unix_micros("came")), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    part = F.floor((F.unix_micros("came") - low) * _FILES / max(1, high - low + 1)).alias("part")
    dealt = settle(came.select(*rows.columns, part))
    files = max(1, -(-count // (_FILES * _FILE_ROWS)))
    for number in range(_FILES):
        dealt.where(F.col("part") == number).drop("part").repartition(files).write.mode("append").parquet(root)
        written = len(spark.read.schema(rows.schema).parquet(root).inputFiles())
        for _ in range((number + 1) * files - written):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(root)
    fixed = {key: F.lit(-1), tie: F.lit(0), "at": F.expr(_FAR)}
    last = spark.range(1).select(
        *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    )
    last.coalesce(1).write.mode("append").parquet(root)
    return feeds.read_arrivals(spark, root, rows.schema, files).withWatermark("at", f"{delay} seconds")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ik.reading_rows(table(spark, sf_dir, "events")).withColumnRenamed("event_id", "tie")
    return _arrivals(spark, read, "id", "tie", 20)


def status_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every feed as the batch operator gives them, from readings in files out of order."""
    return _drained(spark, timed.stream_status_feed(_readings(spark, sf_dir), silent=False), "feed")


def silent_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every feed, from readings in files out of order; timers close the feeds that fall silent."""
    return _drained(spark, timed.stream_status_feed(_readings(spark, sf_dir)), "feed")


# A feed closes at its deadline whether or not it is read again; readings from then on belong to no feed.
SILENT_FEED_STREAM = """
WITH r AS (SELECT user_id AS id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 5000 AS read_at, event_id, event_type || (event_id % 2) AS payload,
  CASE WHEN event_type = 'signup' AND event_id % 50 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'failed' WHEN event_type = 'view' THEN 'pending' ELSE 'processing' END AS status FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY read_at, event_id) - 1 AS seq, min(read_at) OVER (PARTITION BY id) AS began FROM r),
c AS (SELECT *, CASE WHEN status IS NULL THEN 'gone' WHEN status = 'failed' THEN 'done' END AS closing FROM s WHERE read_at < began + 300000000),
l AS (SELECT *, min(seq) FILTER (closing IS NOT NULL) OVER (PARTITION BY id) AS stop FROM c),
k AS (SELECT *, lag(payload) OVER (PARTITION BY id ORDER BY seq) AS before FROM l WHERE stop IS NULL OR seq <= stop)
SELECT id, seq, payload, 'status' AS frame FROM k WHERE status IS NOT NULL AND payload IS DISTINCT FROM before
UNION ALL SELECT id, seq, payload, closing FROM k WHERE closing IS NOT NULL
UNION ALL SELECT id, max(seq) + 1, arg_max(payload, seq), 'timeout' FROM k GROUP BY id HAVING count(closing) = 0"""


def apply_moves_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all applications, from requests in files out of order by up to a day."""
    requests = (
        ap.moves(table(spark, sf_dir, "events"))
        .withColumn("at", F.col("ts").cast("timestamp"))
        .drop("ts")
        .withColumn("initial_state", F.when(F.col("application_id") % 4 == 0, "screened").otherwise("applied"))
        .withColumn("last_position", F.col("application_id") % 3)
    )
    log = timed.stream_moves(_arrivals(spark, requests, "application_id", "request_id", 86_400), linger=400 * 86_400)
    return _drained(spark, log, "moves").where(~F.col("late")).drop("late")


APPLY_MOVES_STREAM = ap.APPLY_MOVES.replace(
    "SELECT request_id, application_id, seq, from_state", "SELECT request_id, application_id, from_state"
)


def stalled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without another update within 900 seconds, from updates in files out of order by up to a day."""
    updates = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("tie"),
        F.when(F.col("event_type").isin("click", "view"), "processing").otherwise("extracted").alias("status"),
    )
    stalled = timed.stream_stalled(_arrivals(spark, updates, "id", "tie", 86_400))
    return _drained(spark, stalled, "stalled").select("id", F.unix_micros("claimed_at").alias("claimed_micros"), "late")


STALLED_STREAM = """
WITH u AS (SELECT user_id % 50 AS id, epoch_us(ts) AS m, event_type IN ('click', 'view') AS claim,
  lead(epoch_us(ts)) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS following FROM events)
SELECT id, m AS claimed_micros, false AS late FROM u WHERE claim AND (following IS NULL OR following > m + 900000000)"""


def settle_uploads_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads in four files: each settled against all that was stored before its micro-batch."""
    root = f"{_shared_root(spark)}/uploads-{uuid.uuid4().hex}"
    uploads = settle(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("upload_id"), F.col("lang").alias("owner_id"), content_hash(F.encode("text", "UTF-8")).alias("content_hash")
        )
    )
    for number in range(_FILES):
        uploads.where(F.pmod("upload_id", F.lit(_FILES)) == number).coalesce(1).write.mode("append").parquet(f"{root}/in")
    arrivals = feeds.read_arrivals(spark, f"{root}/in", uploads.schema)
    feeds.run_uploads(arrivals, f"{root}/store", f"{root}/progress")
    kept = feeds.stored_uploads(spark, f"{root}/store", uploads).select("upload_id", "owner_id", F.col("upload_id").alias("kept_id"))
    answered = feeds.stored_uploads(spark, f"{root}/store", uploads, "answered").select("upload_id", "owner_id", "kept_id")
    return kept.unionByName(answered)


SETTLE_UPLOADS_STREAM = """
WITH d AS (SELECT doc_id AS upload_id, lang AS owner_id, sha256(text) AS h FROM documents)
SELECT upload_id, owner_id, first_value(upload_id) OVER (PARTITION BY owner_id, h ORDER BY upload_id % 4, upload_id) AS kept_id FROM d"""


def dedupe_dispatch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dispatch per (id, attempt); which of the copies is kept is up to arrival."""
    events = feeds.read_stream(spark, sf_dir, "events")
    dispatches = events.select(
        F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("attempt"), F.col("ts").cast("timestamp").alias("at")
    )
    return _drained(spark, feeds.stream_dedupe_dispatch(dispatches, "100 days"), "dispatch").select("id", "attempt")


DEDUPE_DISPATCH_STREAM = "SELECT DISTINCT user_id AS id, event_id % 3 AS attempt FROM events"


QUERIES = {
    "status_feed_stream": status_feed_stream,
    "silent_feed_stream": silent_feed_stream,
    "apply_moves_stream": apply_moves_stream,
    "stalled_stream": stalled_stream,
    "settle_uploads_stream": settle_uploads_stream,
    "dedupe_dispatch_stream": dedupe_dispatch_stream,
}
ORACLES = {
    "status_feed_stream": ik.STATUS_FEED,
    "silent_feed_stream": SILENT_FEED_STREAM,
    "apply_moves_stream": APPLY_MOVES_STREAM,
    "stalled_stream": STALLED_STREAM,
    "settle_uploads_stream": SETTLE_UPLOADS_STREAM,
    "dedupe_dispatch_stream": DEDUPE_DISPATCH_STREAM,
}
