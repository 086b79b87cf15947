"""Registered queries over `events` as model calls: groups, roll-up, scope, prices, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcemark.operators import usage as us
from sourcemark.plans.common import DataFrame, SparkSession, table

# Costs are whole cents scaled by a power of two, so sums do not depend on their order.
_CALLS_SQL = """
c AS (SELECT event_id AS call_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE user_id END AS resume_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE event_id % 977 END AS screening_id,
  'p' || (user_id % 3) AS provider, event_type AS model, 'v' || (event_id % 2) AS prompt_version,
  (props::JSON->>'k')::BIGINT AS input_tokens, user_id % 7 AS output_tokens, event_id % 4 AS cached_input_tokens,
  floor(value * 10)::BIGINT AS latency_ms,
  CASE WHEN event_type = 'view' AND event_id % 11 = 0 THEN NULL ELSE ((props::JSON->>'k')::BIGINT)::DOUBLE / 64 END AS cost_usd FROM events)
"""


def _calls(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_id") % 5
    return events.select(
        F.col("event_id").alias("call_id"),
        F.when(kind >= 2, F.col("user_id")).alias("resume_id"),
        F.when(kind.isin(1, 4), F.col("event_id") % 977).alias("screening_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("prompt_version"),
        k.alias("input_tokens"),
        (F.col("user_id") % 7).alias("output_tokens"),
        (F.col("event_id") % 4).alias("cached_input_tokens"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
        F.when(~((F.col("event_type") == "view") & (F.col("event_id") % 11 == 0)), k.cast("double") / 64).alias("cost_usd"),
    )


_BUCKET = """CASE WHEN resume_id IS NOT NULL AND screening_id IS NULL THEN 'extraction' WHEN screening_id IS NOT NULL AND resume_id IS NULL THEN 'judging'
  WHEN resume_id IS NULL THEN 'unattributed' ELSE 'ambiguous' END"""
_AGG = """count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
  coalesce(sum(cached_input_tokens), 0)::BIGINT AS cached_input_tokens, coalesce(sum(latency_ms), 0)::BIGINT AS latency_ms_total,
  count(cost_usd) AS calls_priced, sum(latency_ms)::DOUBLE / nullif(count(*), 0) AS latency_ms_mean,
  CASE WHEN count(cost_usd) = count(*) THEN coalesce(sum(cost_usd), 0.0) END AS cost_usd"""


def usage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.call_groups(_calls(table(spark, sf_dir, "events")))


USAGE_GROUPS = f"""WITH {_CALLS_SQL} SELECT provider, model, prompt_version, {_BUCKET} AS bucket, {_AGG} FROM c GROUP BY ALL"""


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels, with the notes shown beside them."""
    return us.report_notes(us.usage_report(_calls(table(spark, sf_dir, "events"))))


USAGE_REPORT = f"""WITH {_CALLS_SQL}, b AS (SELECT *, {_BUCKET} AS bucket FROM c),
g AS (SELECT CASE WHEN grouping(bucket) = 1 THEN 'total' WHEN grouping(provider) = 1 THEN 'bucket' ELSE 'group' END AS level,
  provider, model, prompt_version, bucket, {_AGG} FROM b
  GROUP BY GROUPING SETS ((provider, model, prompt_version, bucket), (bucket), ()))
SELECT *, input_tokens + output_tokens AS total_tokens, CASE WHEN cost_usd IS NULL THEN calls - calls_priced ELSE 0 END AS calls_without_price,
  coalesce(bucket IN ('unattributed', 'ambiguous'), false) AND calls > 0 AS attribution_gap,
  NOT coalesce(bucket IN ('unattributed', 'ambiguous'), false) OR calls > 0 AS shown FROM g"""


def usage_empty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only attributed calls: the anomaly buckets stay in the report with zeros."""
    calls = _calls(table(spark, sf_dir, "events"))
    report = us.usage_report(calls.where(F.col("resume_id").isNull() != F.col("screening_id").isNull()))
    return us.report_notes(report).where("level <> 'group'").select(
        "level", "bucket", "calls", "latency_ms_total", "latency_ms_mean", "cost_usd", "shown"
    )


USAGE_EMPTY_BUCKETS = f"""WITH {_CALLS_SQL}, b AS (SELECT *, {_BUCKET} AS bucket FROM c WHERE (resume_id IS NULL) <> (screening_id IS NULL)),
f AS (SELECT 'bucket' AS level, unnest(['extraction', 'judging', 'unattributed', 'ambiguous']) AS bucket UNION ALL SELECT 'total', NULL),
j AS (SELECT f.level, f.bucket, call_id, latency_ms, cost_usd FROM f LEFT JOIN b ON f.bucket IS NULL OR f.bucket = b.bucket)
SELECT level, bucket, count(call_id) AS calls, coalesce(sum(latency_ms), 0)::BIGINT AS latency_ms_total,
  sum(latency_ms)::DOUBLE / nullif(count(call_id), 0) AS latency_ms_mean,
  CASE WHEN count(cost_usd) = count(call_id) THEN coalesce(sum(cost_usd), 0.0) END AS cost_usd,
  NOT coalesce(bucket IN ('unattributed', 'ambiguous'), false) OR count(call_id) > 0 AS shown FROM j GROUP BY level, bucket"""


def _owners(spark: SparkSession, sf_dir: str):
    """Users own their resumes; nations own jobs, customers' numbers are screenings of them."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("resume_id")).distinct()
    resumes = users.select("resume_id", F.col("resume_id").alias("owner_id"))
    screenings = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("screening_id"), F.col("c_nationkey").cast("bigint").alias("job_id")
    )
    jobs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("job_id"), (F.col("n_nationkey").cast("bigint") * 9).alias("owner_id")
    )
    viewers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("viewer_id"))
    return resumes, screenings, jobs, viewers


def usage_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all suppliers' accounts may total together."""
    calls = _calls(table(spark, sf_dir, "events"))
    return us.call_groups(us.scope_calls(calls, *_owners(spark, sf_dir)))


USAGE_SCOPED = f"""WITH {_CALLS_SQL}, o AS (SELECT * FROM c WHERE resume_id IN (SELECT s_suppkey FROM supplier)
  OR screening_id IN (SELECT c_custkey FROM customer WHERE c_nationkey * 9 IN (SELECT s_suppkey FROM supplier)))
SELECT provider, model, prompt_version, {_BUCKET} AS bucket, {_AGG} FROM o GROUP BY ALL"""


def cost_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.cost_of_work(_calls(table(spark, sf_dir, "events")).where(F.col("screening_id").isNotNull()), ["screening_id"])


COST_OF_WORK = f"""WITH {_CALLS_SQL} SELECT screening_id, count(*) AS calls, CASE WHEN count(cost_usd) = count(*) THEN sum(cost_usd) END AS total_cost_usd,
  coalesce(sum(latency_ms), 0)::BIGINT AS total_latency_ms FROM c WHERE screening_id IS NOT NULL GROUP BY screening_id"""


def price_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are powers of two per token; one event type has none."""
    prices = spark.createDataFrame(
        [("view", 2.0, 0.5, 8.0), ("click", 1.0, 0.25, 4.0), ("purchase", 0.0, 0.0, 0.0), ("error", 16.0, 4.0, 64.0)],
        "model string, input_usd double, cached_input_usd double, output_usd double",
    )
    calls = _calls(table(spark, sf_dir, "events")).drop("cost_usd")
    return us.price_calls(calls, prices).select("call_id", "model", "cost_usd")


PRICE_CALLS = f"""WITH {_CALLS_SQL}, p(model, i, c, o) AS (VALUES ('view', 2.0, 0.5, 8.0), ('click', 1.0, 0.25, 4.0), ('purchase', 0.0, 0.0, 0.0), ('error', 16.0, 4.0, 64.0))
SELECT call_id, c.model, ((greatest(input_tokens - cached_input_tokens, 0) * p.i::DOUBLE + cached_input_tokens * p.c::DOUBLE + output_tokens * p.o::DOUBLE) / 1000000.0::DOUBLE)::DOUBLE AS cost_usd
FROM c LEFT JOIN p ON c.model = p.model"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as stored profile counters, per source of the document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    profiles = docs.select("doc_id", "source").join(
        labels.select(
            "doc_id", F.col("quality").alias("claims_verified"), F.col("toxic").alias("claims_dropped"), (F.col("quality") + 1).alias("attempts")
        ),
        "doc_id",
    )
    out = us.quality(profiles, ["source"])
    return out.withColumn("note", us.dropped_note(F.col("claims_dropped"), grouped=False))


QUALITY = """SELECT source, count(*) AS profiles, sum(quality)::BIGINT AS claims_verified, sum(toxic)::BIGINT AS claims_dropped,
  sum(quality + 1)::BIGINT AS extraction_attempts_total, sum(toxic)::DOUBLE / nullif(sum(quality + toxic), 0)::DOUBLE AS hallucination_rate,
  CASE sum(toxic) WHEN 0 THEN NULL WHEN 1 THEN '1 claim dropped' ELSE sum(toxic)::BIGINT || ' claims dropped' END AS note
FROM documents JOIN labels USING (doc_id) GROUP BY source"""


def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return us.quality(
        labels.select(
            F.col("quality").alias("claims_verified"), F.col("toxic").alias("claims_dropped"), F.lit(1).alias("attempts")
        )
    )


QUALITY_OVERALL = """SELECT count(*) AS profiles, sum(quality)::BIGINT AS claims_verified, sum(toxic)::BIGINT AS claims_dropped,
  count(*) AS extraction_attempts_total, sum(toxic)::DOUBLE / sum(quality + toxic)::DOUBLE AS hallucination_rate FROM labels"""


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "extracted").when(F.col("o_orderstatus") == "P", "pending").otherwise("failed")
    resumes = orders.select(status.alias("status"))
    return us.parse_outcomes(resumes)


PARSE_OUTCOMES = """WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'extracted' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status FROM orders)
SELECT status, count(*) AS resumes FROM s GROUP BY status"""


def parse_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified profiles over documents accounted for, in one pass."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("failed")
    return us.parse_success(orders.select(status.alias("status")))


PARSE_SUCCESS = """SELECT count(*) FILTER (o_orderstatus = 'F') AS extracted, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS parse_success FROM orders"""

QUERIES = {
    "usage_groups": usage_groups,
    "usage_report": usage_report,
    "usage_empty_buckets": usage_empty_buckets,
    "usage_scoped": usage_scoped,
    "cost_of_work": cost_of_work,
    "price_calls": price_calls,
    "quality": quality,
    "quality_overall": quality_overall,
    "parse_outcomes": parse_outcomes,
    "parse_success": parse_success,
}
ORACLES = {
    "usage_groups": USAGE_GROUPS,
    "usage_report": USAGE_REPORT,
    "usage_empty_buckets": USAGE_EMPTY_BUCKETS,
    "usage_scoped": USAGE_SCOPED,
    "cost_of_work": COST_OF_WORK,
    "price_calls": PRICE_CALLS,
    "quality": QUALITY,
    "quality_overall": QUALITY_OVERALL,
    "parse_outcomes": PARSE_OUTCOMES,
    "parse_success": PARSE_SUCCESS,
}
