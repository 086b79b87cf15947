"""Many-to-one joins in which one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemark.session import settle

# A key is hot when it holds more than one row in HOT_SHARE (and more than HOT_ROWS rows), so
# there are never more than HOT_SHARE hot keys: a list small enough to broadcast.
HOT_SHARE = 100_000
HOT_ROWS = 1_000


def _deal(
    many: DataFrame, one: DataFrame, on: list[str], hot_share: int, hot_rows: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join on.

    Without hot keys the sides come back as they are. Otherwise rows of a hot key are dealt
    over salts of at most about ``limit`` rows, and the matching row of ``one`` is copied once
    per salt. Dealing goes by a hash of the row, so a retried task deals the same way.
    """
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    large = settle(counts.where(F.col("_rows") > hot_rows))
    in_large = large.agg(F.sum("_rows")).first()[0]
    if in_large is None:
        return many, one, on
    limit = max(hot_rows, in_large // hot_share)
    hot = large.where(F.col("_rows") > limit).select(
        *on, F.ceil(F.col("_rows") / limit).cast("int").alias("_copies")
    )
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    dealt = (
        many.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*many.columns), copies).cast("int"))
        .drop("_copies")
    )
    copied = (
        one.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("_copies")
    )
    return dealt, copied, [*on, "_salt"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot_share: int = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join each row of ``many`` to its single row of ``one`` (a document: heavy work per byte,
    so both sides are spread over all shuffle partitions instead of being coalesced by size).
    """
    dealt, copied, by = _deal(many, one, list(on), hot_share, hot_rows)
    count = _partitions(many)
    return dealt.repartition(count, *by).join(copied.repartition(count, *by), by, how).drop("_salt")


def attach_bundles(
    many: DataFrame,
    one: DataFrame,
    key: str,
    name: str,
    hot_share: int = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of ``one`` with the rows of ``many`` that name them, nested as ``name``.

    A key with many rows gives several bundles, so no array outgrows the limit by much. Both
    sides are spread as in :func:`attach`; the aggregate and the join reuse that partitioning.
    """
    dealt, copied, by = _deal(many, one, [key], hot_share, hot_rows)
    count = _partitions(many)
    rest = [c for c in many.columns if c != key]
    bundles = (
        dealt.repartition(count, *by).groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias(name))
    )
    return bundles.join(copied.repartition(count, *by), by, "left").drop("_salt")


# Narrow rows a broadcast may hold: some ten megabytes.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` written out and counted: broadcast if it is small, joined by shuffle if not."""
    written = settle(df)
    return F.broadcast(written) if written.limit(limit + 1).count() <= limit else written
