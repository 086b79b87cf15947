"""Erasing accounts from stored tables: files first, nothing written if one of them could not go.

Tables are stored in parts by a hash of their first column, and only parts that lose or change rows are written
again. An erasure has three steps. *Stage*: the new parts are written beside the tables, which stay
as they are. *Files*: the stored files of the accounts are deleted; if any fails, the erasure ends
here with an error, and the rows that name those files are all still there. *Publish*: the staged parts replace
the old ones. What is staged depends on nothing that publishing changes, so a publication that was cut off
is finished by publishing again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemark.operators.privacy import SET_NULL, erase_accounts
from sourcemark.session import settle
from sourcemark.sources.keyed import dealt, located

PARTS = 16


class FilesKept(RuntimeError):
    """Some stored files could not be deleted, so no table was touched."""


def store_tables(tables: dict[str, DataFrame], root: str, parts: int = PARTS) -> None:
    """Write every table in parts below ``root``. A task writes its share of every part, so the work is not tied to the number of parts."""
    for name, rows in tables.items():
        part = F.pmod(F.xxhash64(rows.columns[0]), F.lit(parts)).cast("int")
        rows.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The stored tables, with the part their rows lie in."""
    return {name: spark.read.schema(f"{schema}, part int").parquet(f"{root}/{name}") for name, schema in schemas.items()}


def _touched(tables: dict[str, DataFrame], survivors: dict[str, DataFrame], name: str) -> list[int]:
    """Parts of a table with a row that goes or forgets something: at most as many numbers as there are parts."""
    rows = tables[name]
    watched = [key for child, key, _ in SET_NULL if child == name and key in rows.columns]

    def counts(of: DataFrame, what: str) -> DataFrame:
        kept = [F.count(c).alias(f"{what}_{c}") for c in watched]
        return of.groupBy("part").agg(F.count(F.lit(1)).alias(f"{what}_rows"), *kept)

    both = counts(rows, "old").join(counts(survivors[name], "new"), "part", "left")
    same = F.lit(True)
    for c in ["rows", *watched]:
        same = same & (F.col(f"old_{c}") == F.coalesce(F.col(f"new_{c}"), F.lit(0)))
    return [r.part for r in both.where(~same).select("part").collect()]


def stage(tables: dict[str, DataFrame], survivors: dict[str, DataFrame], root: str) -> tuple[str, dict[str, list[int]]]:
    """Write the new parts of all tables; (folder, parts per table)."""
    folder = f"{root}/_staged/{uuid.uuid4().hex}"
    touched = {}
    for name in tables:
        parts = _touched(tables, survivors, name)
        if parts:
            touched[name] = parts
            survivors[name].where(F.col("part").isin(parts)).write.partitionBy("part").parquet(f"{folder}/{name}")
    return folder, touched


def _deleted(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, folder = located(root)
    for batch in batches:
        errors = []
        for key in batch.column(0).to_pylist():
            try:
                system.delete_file(f"{folder}/{key}")
                errors.append(None)
            except FileNotFoundError:
                # Gone already: an earlier attempt got this far.
                errors.append(None)
            except OSError as error:
                errors.append(str(error))
        yield pa.record_batch([batch.column(0), pa.array(errors, pa.string())], ["storage_key", "error"])


def delete_files(keys: DataFrame, root: str) -> DataFrame:
    """Delete the files of ``keys`` (storage_key): storage_key, error (null if it is gone)."""
    asked = keys.select("storage_key").where(F.col("storage_key").isNotNull())
    return dealt(asked).mapInArrow(lambda batches: _deleted(root, batches), "storage_key string, error string")


def publish(tables: dict[str, DataFrame], root: str, folder: str, touched: dict[str, list[int]]) -> None:
    """Put the staged parts in the place of the old ones; may be repeated."""
    for name, parts in touched.items():
        schema = tables[name].schema
        staged = tables[name].sparkSession.read.schema(schema).parquet(f"{folder}/{name}")
        held = {r.part for r in staged.select("part").distinct().collect()}
        writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(f"{root}/{name}")
        # A part that lost all its rows has nothing staged to replace it.
        for part in set(parts) - held:
            staged.where(F.lit(False)).drop("part").write.mode("overwrite").parquet(f"{root}/{name}/part={part}")


def erase_stored(tables: dict[str, DataFrame], accounts: DataFrame, root: str, files: str) -> dict[str, list[int]]:
    """Erase accounts from the tables stored below ``root`` and their files below ``files``; parts written per table."""
    survivors = erase_accounts(tables, accounts)
    keys = settle(survivors.pop("storage_keys"))
    folder, touched = stage(tables, survivors, root)
    failed = settle(delete_files(keys, files)).where(F.col("error").isNotNull())
    first = failed.limit(5).collect()
    if first:
        raise FilesKept(f"{failed.count()} stored files could not be deleted, such as {[r.storage_key for r in first]}")
    publish(tables, root, folder, touched)
    return touched
