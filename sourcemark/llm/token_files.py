"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on ids.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library and written
as one file per partition. A row holds the document's ids, its place in the file and its offset
within it, so the offset over all files needs only one total per file. Readers split files by
stripe; a look-up by document id prunes files and stripes by their statistics, row groups by row
index and Bloom filter.

Encoding goes by white-space-free runs, which this vocabulary never joins: texts of plain Latin runs are
cut into pieces as a whole, others run by run. The ids of the runs and pieces a worker has met are kept
in bounded caches, and the library's model encodes the others. Vocabularies of other rules are refused.

Edge cases: a null or empty text holds the end id only. Rows of one id (repeated rows) stand next
to each other, ordered by text; null ids come first. Extra columns are ignored. An empty table
gives no rows. A text of any length is encoded in blocks that end at white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcemark.llm.common import scratch_folder
from sourcemark.llm.vocabulary import Cutter, WordCache, blocks, kept, shared_file, split_words

END_ID = 1
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
# Runs and pieces that a worker keeps, in each of two generations: more memory, less work.
CACHED = (50_000, 250_000)
LONGEST_KEPT = 32


class Encoder:
    """The ids of white-space-free runs, as little-endian bytes.

    The library's model encodes every piece that the worker has not met.
    """

    def __init__(self, vocabulary: str, cached: tuple[int, int] = CACHED):
        self.kept_pieces = cached[1]
        self.cutter = Cutter(vocabulary)
        self.model = self.cutter.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = WordCache(lambda words: map(self.run, words), limit=cached[0])
        self.plain = WordCache(lambda pieces: map(self.encoded, map(self.cutter.lettered, pieces)), cached[1], LONGEST_KEPT)

    def encoded(self, piece: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self.encoded(piece)
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) >= self.kept_pieces:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[piece] = found
        return found

    def run(self, word: str) -> bytes:
        if "<" not in word:
            return b"".join(map(self.piece, self.cutter.pieces(word)))
        out = []
        for i, part in enumerate(self.cutter.parts(word)):
            if i % 2:
                out.append(self.cutter.tokenizer.token_to_id(part).to_bytes(4, "little"))
            elif part:
                out += map(self.piece, self.cutter.pieces(part))
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.block, blocks(text))) if text else b""

    def block(self, block: str) -> bytes:
        """A block of plain runs is cut and looked up as a whole, any other run by run."""
        pieces = self.cutter.block_pieces(block)
        if pieces is None:
            return b"".join(self.words.lookup(split_words(block)))
        return b"".join(self.plain.lookup(pieces))


def _encoded(vocabulary, end_id: int, cached: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = kept(("ids", vocabulary.value, cached), lambda: Encoder(vocabulary.value, cached))
    end = np.array([end_id], dtype="<u4").tobytes()
    row = offset = 0
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            data = [encoder.ids(value.as_py()) + end for value in part.column(2)]
            sizes = np.array([len(d) // 4 for d in data], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.LargeListArray.from_arrays(
                pa.array(bounds, pa.int64()), pa.array(np.frombuffer(b"".join(data), dtype="<i4"), pa.int32())
            )
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.arange(row, row + len(data)), pa.int64()),
                    pa.array(offset + bounds[:-1], pa.int64()),
                    ids.cast(pa.list_(pa.int32())),
                ],
                ["doc_id", "part", "row", "offset", "ids"],
            )
            row, offset = row + len(data), offset + int(bounds[-1])


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int = END_ID,
    cached: tuple[int, int] = CACHED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents below ``folder``, in ascending order of document id."""
    spark = docs.sparkSession
    vocabulary = shared_file(spark, path)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(count, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text"))
        .select("doc_id", F.spark_partition_id().alias("part"), "text")
        .mapInArrow(
            lambda batches: _encoded(vocabulary, end_id, cached, batches),
            f"doc_id {id_type}, part int, row bigint, offset bigint, ids array<int>",
        )
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD")
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; filters on ``doc_id`` are pushed to statistics, indexes and Bloom filters."""
    return spark.read.orc(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "part", "offset", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Read back from the files: per document its ``start`` over all files, its length and checksum."""
    files = read_tokens(spark, folder)
    id_type = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "part", "offset", "ids").mapInArrow(
        _digests, f"doc_id {id_type}, part int, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # One row per file: the window and the broadcast are as small as the number of files.
    totals = files.groupBy("part").agg(F.sum(F.size("ids").cast("bigint")).alias("ids_in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids_in_part").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).cast("bigint").alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_round_trip(
    docs: DataFrame, path: str, folder: str | None = None, cached: tuple[int, int] = CACHED
) -> DataFrame:
    """Write all documents to ``folder`` (default: a new one in the shared folder) and index them."""
    folder = folder or scratch_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, cached=cached)
    return token_index(docs.sparkSession, folder)
