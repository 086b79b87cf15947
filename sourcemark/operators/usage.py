"""What model calls consumed, reported so that a partial total never looks complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators.joins import small_side

from sourcemark.functions.numbers import rate

# The four ways a call can name the work that paid for it.
BUCKETS = ("extraction", "judging", "unattributed", "ambiguous")
GROUP = ["provider", "model", "prompt_version", "bucket"]
SUMS = ["calls", "input_tokens", "output_tokens", "cached_input_tokens", "latency_ms_total", "calls_priced"]


def bucket() -> Column:
    resume, screening = F.col("resume_id").isNotNull(), F.col("screening_id").isNotNull()
    return (
        F.when(resume & ~screening, BUCKETS[0])
        .when(screening & ~resume, BUCKETS[1])
        .when(~resume & ~screening, BUCKETS[2])
        .otherwise(BUCKETS[3])
    )


def _totals() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("calls"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("cached_input_tokens").alias("cached_input_tokens"),
        total("latency_ms").alias("latency_ms_total"),
        F.count("cost_usd").alias("calls_priced"),
        F.sum("cost_usd").alias("_cost"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    """Mean latency is null without calls; cost is null unless every call has a price."""
    return df.withColumn("latency_ms_mean", rate(F.col("latency_ms_total"), F.col("calls"))).withColumn(
        "cost_usd",
        F.when(F.col("calls_priced") == F.col("calls"), F.coalesce(F.col("_cost"), F.lit(0.0))),
    ).drop("_cost")


def call_groups(calls: DataFrame) -> DataFrame:
    """Totals per provider, model, prompt version and bucket, largest first, ties by name."""
    grouped = calls.withColumn("bucket", bucket()).groupBy(*GROUP).agg(*_totals())
    return _finish(grouped).orderBy(F.col("calls").desc(), *GROUP)


def usage_report(calls: DataFrame) -> DataFrame:
    """Groups, buckets and the grand total from one scan, so they cannot disagree.

    ``level`` is group, bucket or total. Every bucket and the total are present even when
    there is nothing to count: one empty row per bucket is aggregated along and counts zero.
    """
    columns = [*GROUP, "input_tokens", "output_tokens", "cached_input_tokens", "latency_ms", "cost_usd"]
    empty = calls.sparkSession.createDataFrame([(name, 0) for name in BUCKETS], "bucket string, _real int")
    rows = calls.withColumn("bucket", bucket()).select(*columns, F.lit(1).alias("_real"))
    cols = [F.col(c) for c in GROUP]
    rolled = (
        rows.unionByName(empty, allowMissingColumns=True)
        .groupingSets([cols, [F.col("bucket")], []], *cols)
        .agg(
            F.sum("_real").cast("bigint").alias("calls"),
            *_totals()[1:],
            F.grouping("provider").alias("_g"),
            F.grouping("bucket").alias("_b"),
        )
        .withColumn(
            "level", F.when(F.col("_b") == 1, "total").when(F.col("_g") == 1, "bucket").otherwise("group")
        )
        .where((F.col("level") != "group") | (F.col("calls") > 0))
    )
    return _finish(rolled.select("level", *GROUP, *SUMS, "_cost"))


def scope_calls(calls: DataFrame, resumes: DataFrame, screenings: DataFrame, jobs: DataFrame, viewers: DataFrame, admin: bool = False) -> DataFrame:
    """Calls the viewers may total: of their resumes, or of screenings of their jobs.

    One pass over the calls: they meet the distinct keys of both kinds, broadcast only where
    a count allows it, and one filter decides. A call naming both is still one row.
    """
    if admin:
        return calls
    own_resumes = resumes.join(
        viewers, resumes["owner_id"] == viewers["viewer_id"], "left_semi"
    ).select("resume_id").distinct().withColumn("_by_resume", F.lit(True))
    own_jobs = jobs.join(viewers, jobs["owner_id"] == viewers["viewer_id"], "left_semi")
    own_screenings = (
        screenings.join(own_jobs, "job_id", "left_semi")
        .select("screening_id").distinct().withColumn("_by_screening", F.lit(True))
    )
    named = calls.join(small_side(own_resumes), "resume_id", "left").join(
        small_side(own_screenings), "screening_id", "left"
    )
    seen = F.col("_by_resume").isNotNull() | F.col("_by_screening").isNotNull()
    return named.where(seen).select(*calls.columns)


def quality(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Claims verified and dropped; the rate is taken from the totals, null without claims."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    summed = profiles.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("profiles"),
        total("claims_verified").alias("claims_verified"),
        total("claims_dropped").alias("claims_dropped"),
        total("attempts").alias("extraction_attempts_total"),
    )
    return summed.withColumn(
        "hallucination_rate",
        rate(F.col("claims_dropped"), F.col("claims_verified") + F.col("claims_dropped")),
    )


def parse_outcomes(resumes: DataFrame) -> DataFrame:
    """Resumes per status, most frequent first."""
    return resumes.groupBy("status").agg(F.count(F.lit(1)).alias("resumes")).orderBy(
        F.col("resumes").desc(), "status"
    )


def parse_success(resumes: DataFrame) -> DataFrame:
    """How many documents reached a verified profile, over how many are accounted for."""
    counts = resumes.agg(
        F.count_if(F.col("status") == "extracted").alias("extracted"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("parse_success", rate(F.col("extracted"), F.col("total")))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd from prices per million tokens; null for a model without a price."""
    billed = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    cost = (
        billed * F.col("input_usd")
        + F.col("cached_input_tokens") * F.col("cached_input_usd")
        + F.col("output_tokens") * F.col("output_usd")
    ) / F.lit(1_000_000.0)
    return (
        calls.join(prices, "model", "left")
        .withColumn("cost_usd", cost)
        .drop("input_usd", "cached_input_usd", "output_usd")
    )


def cost_of_work(calls: DataFrame, by: list[str]) -> DataFrame:
    """Cost and latency per unit of work; one unpriced call makes the cost unknown."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.when(F.count("cost_usd") == F.count(F.lit(1)), F.sum("cost_usd")).alias("total_cost_usd"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("bigint").alias("total_latency_ms"),
    )


def report_notes(report: DataFrame) -> DataFrame:
    """Columns a reader needs beside the totals: gaps in cost and attribution, what to show."""
    unexpected = F.coalesce(F.col("bucket").isin("unattributed", "ambiguous"), F.lit(False))
    return report.select(
        "*",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.when(F.col("cost_usd").isNull(), F.col("calls") - F.col("calls_priced"))
        .otherwise(0)
        .alias("calls_without_price"),
        (unexpected & (F.col("calls") > 0)).alias("attribution_gap"),
        (~unexpected | (F.col("calls") > 0)).alias("shown"),
    )


def dropped_note(dropped: Column, grouped: bool = True) -> Column:
    """How many claims were refused, in words; null when none were. ``grouped``: thousands set apart, as on a screen."""
    noun = F.when(dropped == 1, " claim dropped").otherwise(" claims dropped")
    number = F.format_number(dropped, 0) if grouped else dropped.cast("string")
    return F.when(dropped > 0, F.concat(number, noun))
