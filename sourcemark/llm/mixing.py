"""Mixing sources to target weights.

Sizes are summed per source, every source gets a share of all words by weight, and the ratio of
target to size is its repetition rate: each document is emitted ``floor(rate)`` times, plus once
more with probability ``rate - floor(rate)``. The draw is a hash of seed and document id, so
reruns and retried tasks agree. A target stops at ``CEILING`` times the size of its source; the
excess is reshared by weight among the others until no target is above its ceiling.

Hot sources: sums are combined before the shuffle, and the rates (a row per source, broadcast
only after a count) meet the documents without moving them.

Edge cases: a null text has size 0; null is a source of its own, ranked last; a source of size 0
has target 0 and rate 0, so its documents are not emitted; a null id draws like the word "null",
repeated rows of one id share their draw; an empty table gives an empty table. The operator keeps
all columns of its input and adds none, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import WORD, free_name, settle
from sourcemark.operators.joins import small_side
from sourcemark.operators.ordered import number_within

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING
) -> DataFrame:
    """From rows of (source, size): one row per source with ``source_size``, ``target``, ``rate``."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = number_within(sums, [], [F.col("source").asc_nulls_last()], "position", start=0)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("position"), F.lit(len(weights))).cast("int"))
    sources = settle(
        ranked.select("source", "source_size", weight.cast("bigint").alias("weight"))
        .withColumn("most", F.col("source_size") * ceiling)
    )
    # Each round fixes the sources above their ceiling and shares the rest among the others.
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["n"] == fixed or not row["weight"]:
            break
        fixed, level = row["n"], (total - row["taken"]) / row["weight"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("bigint")).cast("bigint")


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, ``copies`` and ``taken``."""
    sizes = settle(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    rates = small_side(source_targets(sizes)).withColumnRenamed("source", "_source")
    return (
        sizes.join(rates, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
        )
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as its source's rate says."""
    rates = source_targets(docs.select("source", size_of(F.col("text")).alias("size")))
    key, rate, copy = (free_name(docs, c) for c in ("_source_", "_rate_", "_copy_"))
    rates = small_side(rates.select(F.col("source").alias(key), F.col("rate").alias(rate)))
    return (
        docs.join(rates, F.col("source").eqNullSafe(F.col(key)), "left")
        .withColumn(copy, copies(F.col(rate), F.col("doc_id"), seed).cast("int"))
        .where(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def oracle_sql(documents: str = "documents", ceiling: int = CEILING, seed: str = SEED) -> str:
    """The same result in SQL: the level is read off the running sums of the sorted sources."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(
        f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)
    )
    return f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM {documents}
),
src AS (
  SELECT source, source_size, {weight} END AS weight, {ceiling} * source_size AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)
),
run AS (
  SELECT *, most / weight::DOUBLE AS turn,
    sum(source_size) OVER () - (sum(most) OVER up - most) AS words_left,
    sum(weight) OVER () - (sum(weight) OVER up - weight) AS weight_left
  FROM src WINDOW up AS (ORDER BY most / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
level AS (
  SELECT words_left::DOUBLE / weight_left AS level FROM run
  WHERE turn >= words_left::DOUBLE / weight_left ORDER BY turn, source NULLS LAST LIMIT 1
),
r AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM (SELECT source, source_size, least(most::DOUBLE, weight * coalesce((SELECT level FROM level), 0.0)) AS target FROM src)
),
d AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
    ('0x' || substr(md5('{seed}:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM d)"""
