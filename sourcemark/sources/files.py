"""Stored files and nested result documents at the edges of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Stored files under ``path``: path, length, content. Unread content is never loaded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def read_files_by_key(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the files whose storage key (the end of the path) is asked for."""
    keyed = files.withColumn("storage_key", F.regexp_extract("path", r"([^/]+/[^/]+)\z", 1))
    return keyed.join(keys.select("storage_key").distinct(), "storage_key", "left_semi")


def read_claims(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Proposed claims as JSON lines; a line that does not fit ``schema`` fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_document(column: Column, schema: str | T.DataType) -> Column:
    """A stored JSON result as a nested column; unreadable ones become null and are reported as such."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """Top-level field names of a JSON object that the schema does not know."""
    keys = F.json_object_keys(json)
    return F.array_except(keys, F.array(*[F.lit(name) for name in allowed]))


def write_document(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Export rows as JSON lines, one folder per key value."""
    df.write.mode("errorifexists").partitionBy(*partition_by).json(path)
