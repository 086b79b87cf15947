"""Ordered computations within groups of any size.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here rows are
range-partitioned on (group, order), so a group holding a third of the table is spread over
a third of the slices; each slice is worked on by itself and a carry of at most one row per
slice boundary joins the pieces. ``order`` must be total within a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcemark.session import settle

SLICE = "_slice"


def slice_sorted(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_slice``: slices are consecutive ranges of (by, order).

    Written out once, because the carry and the rows must agree on slice numbers.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(c) for c in by], *order)
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()))


def carried(
    sliced: DataFrame, by: Sequence[str], per_slice: DataFrame, carry: Callable[[Window], Column]
) -> DataFrame:
    """One row for each slice that continues a group: at most (slices - 1) rows in all."""
    before = Window.partitionBy(*by).orderBy(SLICE)
    first = F.row_number().over(before) == 1
    return (
        per_slice.select(*by, SLICE, carry(before).alias("_carry"), first.alias("_opens"))
        .where(~F.col("_opens"))
        .drop("_opens")
    )


def number_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, start: int = 1
) -> DataFrame:
    """``row_number`` per group, counted from ``start``, without one task per group."""
    sliced = slice_sorted(df, by, order)
    local = Window.partitionBy(SLICE, *by).orderBy(*order)
    sizes = sliced.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_size"))
    carry = carried(
        sliced,
        by,
        sizes,
        lambda before: F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)),
    )
    return (
        sliced.withColumn("_n", F.row_number().over(local))
        .join(F.broadcast(carry), [*by, SLICE], "left")
        .withColumn(
            name, (F.col("_n") + F.coalesce(F.col("_carry"), F.lit(0)) + (start - 1)).cast("bigint")
        )
        .drop("_n", "_carry", SLICE)
    )


def previous_within(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], name: str
) -> DataFrame:
    """``name``: a struct of ``values`` from the row before in the group, null on the first row."""
    ascending = [F.col(c) for c in order]
    sliced = slice_sorted(df, by, ascending)
    local = Window.partitionBy(SLICE, *by).orderBy(*ascending)
    packed = F.struct(*values)
    last = sliced.groupBy(*by, SLICE).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carry = carried(sliced, by, last, lambda before: F.lag("_last").over(before))
    return (
        sliced.withColumn(name, F.lag(packed).over(local))
        .join(F.broadcast(carry), [*by, SLICE], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry", SLICE)
    )
