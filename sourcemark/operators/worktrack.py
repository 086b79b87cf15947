"""Retries, abandoned work and change feeds, as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators.ordered import previous_within

# Error classes no retry can help, and those whose message holds no user text.
PERMANENT = (
    "ParseError",
    "UnsupportedFileTypeError",
    "CorruptDocumentError",
    "EmptyDocumentError",
    "NoTextLayerError",
    "ObjectNotFoundError",
    "LLMConfigError",
    "OCRUnavailableError",
    "NotScreenable",
)
QUOTABLE = (
    "LLMError",
    "LLMConfigError",
    "LLMUnavailableError",
    "LLMResponseError",
    "ParseError",
    "UnsupportedFileTypeError",
    "CorruptDocumentError",
    "EmptyDocumentError",
    "NoTextLayerError",
    "OCRUnavailableError",
    "NotScreenable",
    "WorkerVanished",
)
# Attempts before giving up, first delay, and when held work counts as abandoned.
MAX_ATTEMPTS = 3
BASE_SECONDS = 5.0
VISIBILITY_SECONDS = 900
# How long one feed is followed, and the statuses still in flight.
STREAM_SECONDS = 300
IN_FLIGHT = ("pending", "processing")
RESUME_RETRYABLE = ("dead_lettered", "failed", "parsed")
SCREENING_RETRYABLE = ("dead_lettered", "failed")


def decide_retry(
    failures: DataFrame,
    permanent: tuple[str, ...] = PERMANENT,
    quotable: tuple[str, ...] = QUOTABLE,
    max_attempts: int = MAX_ATTEMPTS,
    base_seconds: float = BASE_SECONDS,
) -> DataFrame:
    """(error_class, message, failed_attempts including this one) → verdict, delay, reason.

    Unknown classes are retried. Their message may quote anything, so only the type name is kept.
    """
    n = F.col("failed_attempts")
    described = F.when(
        F.col("error_class").isin(*quotable), F.concat("error_class", F.lit(": "), "message")
    ).otherwise(F.col("error_class"))
    verdict = (
        F.when(F.col("error_class").isin(*permanent), "permanent")
        .when(n >= max_attempts, "exhausted")
        .otherwise("retry")
    )
    count = n.cast("string")
    reason = (
        F.when(F.col("verdict") == "permanent", described)
        .when(
            F.col("verdict") == "exhausted",
            F.concat(F.lit("Gave up after "), count, F.lit(" attempts. Last error — "), described),
        )
        .otherwise(F.concat(F.lit("Attempt "), count, F.lit(" failed, retrying — "), described))
    )
    delay = F.lit(base_seconds) * F.pow(F.lit(2.0), F.greatest(n - 1, F.lit(0)))
    return (
        failures.withColumn("verdict", verdict)
        .withColumn("retry_after_seconds", F.when(F.col("verdict") == "retry", delay))
        .withColumn("reason", reason)
    )


def is_stalled(last_attempt_at: Column, now: Column, seconds: int = VISIBILITY_SECONDS) -> Column:
    """Held longer than a live worker would; never claimed counts as abandoned."""
    cutoff = now - F.make_dt_interval(secs=F.lit(seconds))
    return last_attempt_at.isNull() | (last_attempt_at <= cutoff)


def find_stalled(rows: DataFrame, now: Column, seconds: int = VISIBILITY_SECONDS) -> DataFrame:
    """Rows still marked as processing whose worker is gone."""
    return rows.where((F.col("status") == "processing") & is_stalled(F.col("last_attempt_at"), now, seconds))


def reclaim_stalled(rows: DataFrame, now: Column, seconds: int = VISIBILITY_SECONDS) -> DataFrame:
    """Each abandoned row counts as one more failure and is judged by the retry policy."""
    failures = (
        find_stalled(rows, now, seconds)
        .withColumn("failed_attempts", F.col("failed_attempts") + 1)
        .withColumn("error_class", F.lit("WorkerVanished"))
        .withColumn("message", F.lit("the worker stopped before it finished"))
    )
    after = F.when(F.col("verdict") == "exhausted", "dead_lettered").otherwise("pending")
    return decide_retry(failures).withColumn("status", after)


def retryable(
    status: Column, last_attempt_at: Column, now: Column, statuses: tuple[str, ...] = RESUME_RETRYABLE
) -> Column:
    """Whether asking for another run would be accepted."""
    return status.isin(*statuses) | ((status == "processing") & is_stalled(last_attempt_at, now))


def status_feed(readings: DataFrame) -> DataFrame:
    """What a follower of each row is sent: ``status`` on first sight and on every change of
    payload, then one of ``done``, ``gone`` or ``timeout``.

    ``readings``: id, at, seq (orders readings of one id), status (null = deleted), payload.
    Nothing is sent after the closing frame.
    """
    # ``seq`` is the poll number of the row, so the deadline is measured from the first poll.
    start = readings.groupBy("id").agg(F.min("at").alias("_from"))
    timed = readings.join(start, "id").withColumn(
        "_late", F.col("at") >= F.col("_from") + F.make_dt_interval(secs=F.lit(STREAM_SECONDS))
    )
    closing = (
        F.when(F.col("status").isNull(), "gone")
        .when(~F.col("status").isin(*IN_FLIGHT), "done")
        .when(F.col("_late"), "timeout")
    )
    marked = timed.withColumn("_closing", closing)
    ends = marked.groupBy("id").agg(F.min(F.when(F.col("_closing").isNotNull(), F.col("seq"))).alias("_end"))
    live = marked.join(ends, "id").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    linked = previous_within(
        live.select("id", "at", "seq", "status", "payload", "_closing"), ["id"], ["seq"], ["payload"], "_before"
    )
    changed = F.col("status").isNotNull() & (
        F.col("_before").isNull() | ~F.col("payload").eqNullSafe(F.col("_before.payload"))
    )
    frames = F.concat(
        F.when(changed, F.array(F.lit("status"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_closing").isNotNull(), F.array(F.col("_closing"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return linked.select("id", "at", "seq", "status", "payload", F.explode(frames).alias("frame"))


def dedupe_dispatch(dispatches: DataFrame) -> DataFrame:
    """One dispatch per (id, attempt): the earliest."""
    rest = [c for c in dispatches.columns if c not in ("id", "attempt")]
    first = dispatches.groupBy("id", "attempt").agg(F.min(F.struct("at", *[c for c in rest if c != "at"])).alias("_f"))
    return first.select("id", "attempt", "_f.*")
