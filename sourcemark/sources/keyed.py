"""Stored files by key, as a Spark data source: tasks open the files asked for, and nothing is ever listed.

The asked keys are a table of their own, written in sorted parts. Every part is cut into ranges of keys, and a
range is one task: it reads its keys, joins each to the store's root and opens that file. A key without a file
gives a row with a null length, so a caller sees what is missing.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sourcemark.session import use_checkpoint_dir

# The source travels to the executors, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "stored_files"
SCHEMA = "storage_key string, length bigint, content binary"
# Files one task opens, and bytes it hands on at once.
KEYS_PER_TASK = 1_000
BATCH_BYTES = 32 << 20


def located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """A file system and a path in it; a plain path or ``file:`` URI is a shared local folder."""
    if uri.startswith("file:/"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def read_stored(system: arrow_fs.FileSystem, path: str) -> bytes | None:
    """The bytes of one file; None if there is none."""
    try:
        with system.open_input_stream(path, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


@dataclass
class KeyRange(InputPartition):
    """Some keys of one part of the key table."""

    part: str
    first: int
    count: int


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.keys = options["keys"]
        self.per_task = int(options.get("keys_per_task", KEYS_PER_TASK))
        self.opened = options.get("opened", "true") == "true"

    def partitions(self) -> list[KeyRange]:
        """Ranges of keys, from the footers of the key table."""
        system, folder = located(self.keys)
        parts = [f.path for f in system.get_file_info(arrow_fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        ranges = []
        for part in sorted(parts):
            with system.open_input_file(part) as file:
                rows = pq.ParquetFile(file).metadata.num_rows
            ranges += [KeyRange(part, first, min(self.per_task, rows - first)) for first in range(0, rows, self.per_task)]
        return ranges

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.keys)
        store, root = located(self.root)
        with system.open_input_file(partition.part) as file:
            keys = pq.read_table(file, columns=["storage_key"]).column(0).slice(partition.first, partition.count).to_pylist()
        if not self.opened:
            lengths = [info.size for info in store.get_file_info([f"{root}/{key}" for key in keys])]
            yield _batch([(key, length, None) for key, length in zip(keys, lengths, strict=True)])
            return
        held: list[tuple] = []
        size = 0
        for key in keys:
            content = read_stored(store, f"{root}/{key}")
            held.append((key, None if content is None else len(content), content))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.binary()
    columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
    return pa.record_batch(columns, ["storage_key", "length", "content"])


class KeyedFiles(DataSource):
    """``spark.read.format("stored_files").option("root", ...).option("keys", <folder of a key table>)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(dict(self.options))


def read_by_key(spark: SparkSession, root: str, keys: DataFrame, per_task: int = KEYS_PER_TASK, opened: bool = True) -> DataFrame:
    """The files below ``root`` that ``keys`` (storage_key) asks for, each once: storage_key, length, content.

    With ``opened`` false, only their lengths are looked up and the content is null. Null keys ask for nothing; keys that lead out of the store are refused.
    """
    spark.dataSource.register(KeyedFiles)
    asked = keys.select("storage_key").where(F.col("storage_key").isNotNull()).distinct()
    leads_out = F.col("storage_key").rlike(r"(^|/)\.\.(/|$)|^/")
    asked = asked.withColumn(
        "storage_key", F.when(leads_out, F.raise_error(F.concat(F.lit("not a storage key: "), "storage_key"))).otherwise(F.col("storage_key"))
    )
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/keys-{uuid.uuid4().hex}"
    asked.sortWithinPartitions("storage_key").write.parquet(folder)
    reader = spark.read.format(FORMAT).option("root", root).option("keys", folder)
    return reader.option("keys_per_task", str(per_task)).option("opened", str(opened).lower()).load()


def _stored(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, folder = located(root)
    made = set()
    for batch in batches:
        for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            path = f"{folder}/{key}"
            parent = path.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(path, compression=None) as stream:
                stream.write(content or b"")
        yield pa.record_batch([batch.column(0)], ["storage_key"])


def dealt(files: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions by key: opening a file costs far more than the bytes of a row, by which Spark would size its tasks."""
    count = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(count, "storage_key")


def store_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``content`` under its ``storage_key`` below ``root``; the keys written. A retried task writes the same bytes again."""
    return dealt(files.select("storage_key", "content")).mapInArrow(lambda batches: _stored(root, batches), "storage_key string")
