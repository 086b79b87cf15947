"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemark.session import settle, use_checkpoint_dir

__all__ = ["free_name", "let", "read_table", "scratch_folder", "settle", "WORD"]

# Words of the corpus statistics: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the folder may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a URI that every executor reaches."""
    use_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
