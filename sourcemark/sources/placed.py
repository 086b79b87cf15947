"""Tables stored by key, so that joins on the key move no rows.

A table is bucketed and sorted by its key; two tables of the same key and number of buckets are joined and
grouped bucket by bucket, without an exchange. A bucket is one task, so rows of a key that holds many are
stored apart, as a plain table: they are few keys, and joins deal them out over salts as elsewhere.

Stores are folders. A session that opens one declares it in its own catalog, under a name no other store has.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemark.operators.joins import HOT_ROWS, HOT_SHARE, attach_bundles
from sourcemark.session import settle


@dataclass
class Placed:
    """A stored table: rows bucketed by ``key``, and the rows of hot keys and of none."""

    key: str
    even: DataFrame
    hot: DataFrame

    def rows(self) -> DataFrame:
        return self.even.unionByName(self.hot)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def store_placed(
    rows: DataFrame, path: str, key: str, buckets: int, hot_share: int = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> Placed:
    """Write ``rows`` below ``path``. A key is hot by the same measure as in :func:`joins.attach`."""
    large = settle(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows))
    limit = max(hot_rows, (large.agg(F.sum("_rows")).first()[0] or 0) // hot_share)
    # At most ``hot_share`` keys.
    hot = F.broadcast(large.where(F.col("_rows") > limit).select(key))
    apart = rows.join(hot, key, "left_semi").unionByName(rows.where(F.col(key).isNull()))
    apart.write.parquet(f"{path}/hot")
    even = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti").select(*rows.columns)
    name = f"placed_{uuid.uuid4().hex}"
    writer = even.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").option("path", f"{path}/even").saveAsTable(name)
    return open_placed(rows.sparkSession, path, _schema(rows), key, buckets)


def open_placed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> Placed:
    """A table stored before, maybe by another session, under the schema and buckets it was stored with."""
    name = f"placed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/even'"
    )
    return Placed(key, spark.table(name), spark.read.schema(schema).parquet(f"{path}/hot"))


def bundles(many: Placed, one: Placed, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``one`` with the rows of ``many`` that name them, nested as ``name``; see :func:`joins.attach_bundles`.

    No row of either table is exchanged but for hot keys: those of ``many``, with their partners.
    """
    key = many.key
    rest = list(columns) if columns is not None else [c for c in many.even.columns if c != key]
    grouped = many.even.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias(name))
    apart = many.hot.select(key, *rest)
    partners = one.rows().join(F.broadcast(apart.select(key).distinct()), key, "left_semi")
    hot = attach_bundles(apart, partners, key, name)
    return grouped.join(one.even, key, "left").unionByName(hot)
