"""Cross-tokenizer alignment by diagonal run skipping, and corpus-wide counts of linked ids.

A text has two token sequences A and B over the same bytes; each is an array of byte ends. At an
index shift where the next ends agree, the stretch of one-to-one tokens is measured by exponential
probing: whole slices of both arrays are compared at that shift, doubling while they agree and
halving where they do not, and the stretch is jumped. Where the next ends differ, the irregular group
is resolved by itself up to the next common end, which gives its links and the new shift.

A task aligns its texts once and writes them, with the distinct linked id pairs they hold, as files
of a bounded number of links in the shared folder; ids of pairs in a file are numbers within it. Spark
adds up the pairs of all files, finds the highest count per B id, and brings to each file the totals
of its own pairs only; a last pass reads the files and sums up per document. So neither a document's
links nor the table of pairs ever meet in one place, and a pair that is everywhere is one row per file.

Tokens of the two libraries are kept per piece of text between single spaces, over which neither
vocabulary joins tokens (checked for the B model when it is loaded; without that, texts are encoded
whole). The A vocabulary must be byte-level without a normaliser.

Edge cases: texts that are null or empty, or whose A or B bytes differ from a space and the text, have no
tokens: zeros and an empty digest. Texts are read whole; a long one is aligned block by block at
spaces. Repeated rows count and come back as often as they are there, ids may be null, an empty
table gives no rows, other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemark.llm import shared_files
from sourcemark.llm.common import scratch_folder
from sourcemark.llm.vocabulary import FILE_LIMIT, byte_letters, kept, shared_file

# Links a file holds before it is closed; code points aligned at once; tokens kept per worker.
FILE_LINKS = 3_000_000
BLOCK = 1 << 19
KEPT_TOKENS = 4_000_000
B_BITS = 20
# Width of the first probe.
PROBE = 8

# A single space between other characters: there both vocabularies start a new token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Latin letters, and full stops or commas after them: the byte-level splitter makes a word and one run of signs
# of these, so the model can have them at once. The library's own splitter cuts all other pieces.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([.,]*)")
SPACE_MARK = "▁"


@dataclass
class Pair:
    """Groups and links of two sequences of ends, as index arrays."""

    a_ends: np.ndarray
    b_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _run_length(a: bytes, b: bytes, i: int, j: int) -> int:
    """Ends (of 8 bytes) that agree from ``(i, j)`` on at the shift ``j - i``; at least one does."""
    at, to, width = 8 * i + 8, 8 * j + 8, 8 * PROBE
    top = min(len(a) - at, len(b) - to)
    length = 0
    while length < top and a[at + length : at + length + width] == b[to + length : to + length + width]:
        length += width
        width *= 2
    if length >= top:
        return top // 8 + 1
    # The slice of this width disagrees somewhere: halve it down to the first end that does.
    while width > 8:
        width //= 2
        if a[at + length : at + length + width] == b[to + length : to + length + width]:
            length += width
    return min(length, top) // 8 + 1


def align(a: np.ndarray, b: np.ndarray) -> Pair:
    """Groups between common ends, and all index pairs whose byte ranges overlap.

    Both are strictly ascending and have the same last end. ``a_ends`` and ``b_ends`` are the
    indices at which the groups end, in order.
    """
    runs: list[int] = []
    irregular: list[int] = []
    left, right = a.tolist(), b.tolist()
    left_bytes, right_bytes = a.tobytes(), b.tobytes()
    i = j = 0
    count = len(left)
    while i < count:
        x, y = left[i], right[j]
        if x == y:
            length = _run_length(left_bytes, right_bytes, i, j)
            runs += (i, j, length)
            i += length
            j += length
            continue
        irregular += (i, j)
        while x != y:
            if x < y:
                i += 1
                x = left[i]
            else:
                j += 1
                y = right[j]
        i += 1
        j += 1
        irregular += (i, j)
    starts_a, starts_b, lengths = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    run_a, run_b = _steps(starts_a, lengths), _steps(starts_b, lengths)
    first_a, first_b, last_a, last_b = np.array(irregular, dtype=np.int64).reshape(-1, 4).T
    # Links of the irregular groups: one for every stretch between neighbouring ends of either side.
    inner_a, inner_b = _steps(first_a, last_a - first_a), _steps(first_b, last_b - first_b)
    met = np.sort(np.concatenate([a[inner_a], b[inner_b]]), kind="stable")
    met = met[np.concatenate([met[1:] != met[:-1], [True]])] if len(met) else met
    link_a = np.concatenate([run_a, inner_a[np.searchsorted(a[inner_a], met)]])
    link_b = np.concatenate([run_b, inner_b[np.searchsorted(b[inner_b], met)]])
    order = np.argsort(link_a + link_b, kind="stable")
    a_ends, b_ends = np.concatenate([run_a + 1, last_a]), np.concatenate([run_b + 1, last_b])
    return Pair(np.sort(a_ends, kind="stable"), np.sort(b_ends, kind="stable"), link_a[order], link_b[order])


def _steps(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, as many as its length says."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Column:
    """Numbers that grow at the end."""

    def __init__(self):
        self.values, self.count = np.zeros(1 << 16, dtype=np.int64), 0

    def extend(self, new: list[int] | np.ndarray) -> None:
        last = self.count + len(new)
        if last > len(self.values):
            self.values = np.concatenate([self.values[: self.count], np.zeros(last, dtype=np.int64)])
        self.values[self.count : last] = new
        self.count = last


class Side:
    """Tokens of pieces of text, one after the other: ids, byte lengths, and where a piece's tokens start."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.token_sizes = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.sizes, self.starts = Column(), Column(), Column()
        self.starts.extend([0])

    def extend(self, ids: list[list[int]], wholes: list[bytes]) -> list[int]:
        """Adds the tokens of some pieces; which of them do not spell the bytes of theirs."""
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = list(chain.from_iterable(ids))
        self.starts.extend(np.cumsum(counts) + self.ids.count)
        self.ids.extend(flat)
        sizes = self.token_sizes[flat]
        self.sizes.extend(sizes)
        # All bytes at once; if those agree, and the sizes of all pieces do, every piece does.
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        spelled = b"".join(map(self.token_bytes.__getitem__, flat))
        if spelled == b"".join(wholes) and (np.diff(ends) == np.fromiter(map(len, wholes), dtype=np.int64)).all():
            return []
        return [k for k, whole in enumerate(wholes) if spelled[ends[k] : ends[k + 1]] != whole]

    def tokens(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte lengths of the pieces at ``slots``, in order, and tokens per piece."""
        starts = self.starts.values
        counts = starts[slots + 1] - starts[slots]
        at = _steps(starts[slots], counts)
        return self.ids.values[at], self.sizes.values[at], counts


class Tokenizers:
    """Both libraries, with the tokens of the pieces met so far, bounded in number."""

    def __init__(self, a_file: str, b_file: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(a_file)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("the A vocabulary must be byte-level without a normaliser")
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()
        byte_of = {letter: byte for byte, letter in self.letters.items()}
        a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b_file)
        b_bytes = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE_MARK, " ").encode() for p in model.pieces
        ]
        if len(b_bytes) > 1 << B_BITS:
            raise ValueError(f"the B vocabulary has over {1 << B_BITS} pieces")
        norm = model.normalizer_spec
        self.cuts = (
            not norm.precompiled_charsmap
            and not norm.remove_extra_whitespaces
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in model.pieces)
        )
        # For the digest: an A id inside or at the end of its group, a B id inside or at the end.
        self.a_count, self.b_count = len(a_bytes), len(b_bytes)
        self.spelled = [f"{i}{sign}" for signs, n in ((",|", self.a_count), (",;", self.b_count)) for sign in signs for i in range(n)]
        self.side_a, self.side_b = Side(a_bytes), Side(b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.side_a.forget()
        self.side_b.forget()
        self.wrong: set[int] = set()

    def _a_ids(self, piece: str, spaced: str) -> list[int]:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.a.encode(spaced, add_special_tokens=False).ids
        word, signs = plain.groups()
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        tokens = self.a.model.tokenize(self.letters[32] + letters)
        if signs:
            tokens += self.a.model.tokenize(signs)
        return [t.id for t in tokens]

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def place(self, pieces: list[str]) -> np.ndarray:
        """Slots of ``pieces``; unknown ones are encoded. All slots stay valid until the next call."""
        if self.side_a.ids.count + self.side_b.ids.count > KEPT_TOKENS:
            self._forget()
        slots = self.slots
        found = list(map(slots.get, pieces))
        new = list(dict.fromkeys(p for p, slot in zip(pieces, found, strict=True) if slot is None)) if None in found else []
        if new:
            first = len(slots)
            slots.update(zip(new, range(first, first + len(new)), strict=True))
            spaced = [" " + piece for piece in new]
            a_ids = list(map(self._a_ids, new, spaced))
            b_ids = self.b.encode(new, num_threads=1)
            wholes = [piece.encode() for piece in spaced]
            for side, ids in ((self.side_a, a_ids), (self.side_b, b_ids)):
                self.wrong.update(first + k for k in side.extend(ids, wholes))
            found = [slots[p] if slot is None else slot for p, slot in zip(pieces, found, strict=True)]
        return np.array(found, dtype=np.int64)


class _Document:
    """What has been seen of one text so far."""

    def __init__(self):
        self.right = True
        self.a = self.b = self.groups = 0
        self.digest = hashlib.sha256()
        self.links: list[np.ndarray] = []

    def row(self) -> tuple[int, int, int, str, np.ndarray]:
        if not self.right or not self.a:
            return 0, 0, 0, "", np.zeros(0, dtype=np.int64)
        return self.a, self.b, self.groups, self.digest.hexdigest(), np.concatenate(self.links)


def _blocks(texts: Iterator[str | None], tokenizers: Tokenizers) -> Iterator[tuple[list[list[str]], list[bool]]]:
    """Texts in blocks of about ``BLOCK`` code points: pieces per text, and whether the text ends there."""
    held: list[list[str]] = []
    ended: list[bool] = []
    size = 0
    for text in texts:
        pieces = tokenizers.pieces(text) if text else []
        if len(text or "") <= BLOCK:
            held.append(pieces)
            ended.append(True)
            size += len(text or "")
        else:
            first = 0
            for last, piece in enumerate(pieces, 1):
                size += len(piece) + 1
                if size >= BLOCK:
                    yield [*held, pieces[first:last]], [*ended, last == len(pieces)]
                    held, ended, size, first = [], [], 0, last
            if first < len(pieces):
                held.append(pieces[first:])
                ended.append(True)
        if size >= BLOCK:
            yield held, ended
            held, ended, size = [], [], 0
    if held:
        yield held, ended


def documents(texts: Iterator[str | None], tokenizers: Tokenizers) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
    """Per text: A tokens, B tokens, groups, digest of the groups, and its links as numbers of both ids."""
    current = _Document()
    for parts, ended in _blocks(texts, tokenizers):
        slots = tokenizers.place([piece for pieces in parts for piece in pieces])
        bounds = np.cumsum([0, *map(len, parts)])
        wrong = np.isin(slots, np.fromiter(tokenizers.wrong, dtype=np.int64)) if tokenizers.wrong else None
        if wrong is not None and wrong.any():
            # A text with one wrong piece has no tokens: its pieces are left out of the arrays.
            bad = [bool(wrong[x:y].any()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            keep = np.repeat(~np.array(bad), np.diff(bounds))
            slots = slots[keep]
            bounds = np.cumsum([0, *(0 if b else len(p) for b, p in zip(bad, parts, strict=True))])
        else:
            bad = [False] * len(parts)
        a_ids, a_sizes, a_counts = tokenizers.side_a.tokens(slots)
        b_ids, b_sizes, b_counts = tokenizers.side_b.tokens(slots)
        found = align(np.cumsum(a_sizes), np.cumsum(b_sizes))
        spelled = _spelled(a_ids, b_ids, found, tokenizers)
        # Texts end at common ends, so each owns whole groups and links.
        a_at = np.concatenate([[0], np.cumsum(a_counts)])[bounds]
        b_at = np.concatenate([[0], np.cumsum(b_counts)])[bounds]
        groups_at = np.searchsorted(found.a_ends, a_at, side="right")
        links_at = np.searchsorted(found.link_a + found.link_b, a_at + b_at)
        keys = (a_ids[found.link_a] << B_BITS) | b_ids[found.link_b]
        for k, done in enumerate(ended):
            current.right &= not bad[k]
            if a_at[k] < a_at[k + 1]:
                text = "".join(spelled[a_at[k] + b_at[k] : a_at[k + 1] + b_at[k + 1]])
                current.digest.update((text[:-1] if not current.a else ";" + text[:-1]).encode())
                current.a += int(a_at[k + 1] - a_at[k])
                current.b += int(b_at[k + 1] - b_at[k])
                current.groups += int(groups_at[k + 1] - groups_at[k])
                current.links.append(keys[links_at[k] : links_at[k + 1]])
            if done:
                yield current.row()
                current = _Document()


def _spelled(a_ids: np.ndarray, b_ids: np.ndarray, found: Pair, tokenizers: Tokenizers) -> list[str]:
    """Ids with the sign that follows each, group by group: first the A ids, then the B ids."""
    a_last = np.zeros(len(a_ids), dtype=np.int64)
    b_last = np.zeros(len(b_ids), dtype=np.int64)
    a_last[found.a_ends - 1] = 1
    b_last[found.b_ends - 1] = 1
    out = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    # Before a group's A ids stand the B ids of earlier groups; before its B ids, its own A ids too.
    earlier = np.concatenate([[0], found.b_ends[:-1]]) if len(found.b_ends) else found.b_ends
    a_sizes, b_sizes = (np.diff(ends, prepend=0) for ends in (found.a_ends, found.b_ends))
    out[np.arange(len(a_ids)) + np.repeat(earlier, a_sizes)] = a_ids + a_last * tokenizers.a_count
    out[np.arange(len(b_ids)) + np.repeat(found.a_ends, b_sizes)] = 2 * tokenizers.a_count + b_ids + b_last * tokenizers.b_count
    return list(map(tokenizers.spelled.__getitem__, out.tolist()))


class _File:
    """Aligned texts until there are enough links for a file."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.rows: list[tuple] = []
        self.links = 0

    def write(self, folder: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The file's URI and its distinct pairs with their counts, the commonest first."""
        keys = np.concatenate([r[4] for r in self.rows]) if self.rows else np.zeros(0, dtype=np.int64)
        coded = pa.array(keys).dictionary_encode()
        pairs, numbers = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        counts = np.bincount(numbers, minlength=len(pairs))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        bounds = np.cumsum([0, *(len(r[4]) for r in self.rows)])
        links = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(place[numbers], pa.int32()))
        table = pa.table(
            [pa.chunked_array(self.ids).combine_chunks(), *(pa.array([r[c] for r in self.rows]) for c in range(4)), links],
            ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
        )
        uri, stream = shared_files.create(folder, ".arrow")
        with stream, pa.ipc.new_stream(stream, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table, max_chunksize=2000)
        return uri, pairs[order], counts[order]


def _aligned(files, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizers = kept(("align", files[0].value, files[1].value), lambda: Tokenizers(files[0].value, files[1].value))
    task = TaskContext.get().partitionId() << 32
    number = 0
    current = _File()
    for batch in batches:
        first = 0
        rows = documents((v.as_py() for v in batch.column(1)), tokenizers)
        for last, row in enumerate(rows, 1):
            current.rows.append(row)
            current.links += len(row[4])
            if current.links >= FILE_LINKS:
                current.ids.append(batch.column(0).slice(first, last - first))
                first = last
                yield _manifest(task + number, current.write(folder))
                number += 1
                current = _File()
        current.ids.append(batch.column(0).slice(first))
    if current.rows:
        yield _manifest(task + number, current.write(folder))


def _manifest(number: int, written: tuple[str, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    uri, pairs, counts = written
    return pa.record_batch(
        [
            pa.array([number], pa.int64()),
            pa.array([uri]),
            pa.array([pairs], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())),
        ],
        ["file", "uri", "pairs", "counts"],
    )


def align_files(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align all texts into files of the shared folder: one row per file with its pairs and their counts."""
    spark = docs.sparkSession
    if os.path.getsize(b_path) > FILE_LIMIT:
        raise ValueError(f"{b_path} has over {FILE_LIMIT} bytes; that much is not broadcast")
    with open(b_path, "rb") as file:
        files = shared_file(spark, a_path), spark.sparkContext.broadcast(file.read())
    folder = scratch_folder(spark, "aligned")
    manifest = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _aligned(files, f"{folder}/texts", batches),
        "file bigint, uri string, pairs array<bigint>, counts array<bigint>",
    )
    # Written, as file names differ between attempts: all later steps see the same files.
    manifest.write.parquet(f"{folder}/files")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/files")


def link_counts(files: DataFrame) -> DataFrame:
    """Linked id pairs of the corpus: pair, a_id, b_id, count, and whether no pair of that B id has more."""
    listed = files.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    folder = scratch_folder(files.sparkSession, "pairs")
    totals.write.parquet(folder)
    totals = files.sparkSession.read.schema(totals.schema).parquet(folder)
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # One row per id of the B vocabulary, whose size is checked when it is loaded.
    highest = totals.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    rated = totals.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")
    return rated.select(
        "pair", F.shiftright("pair", B_BITS).alias("a_id"), "b_id", "count", (F.col("count") == F.col("highest")).alias("is_best")
    )


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """One file's documents with the sums over their links; ``right`` has the totals of its pairs."""
    place = right.column("place").to_numpy()
    count = np.zeros(len(place), dtype=np.int64)
    best = np.zeros(len(place), dtype=np.int64)
    count[place] = right.column("count").to_numpy()
    best[place] = right.column("is_best").to_numpy(zero_copy_only=False).astype(np.int64)
    parts = []
    with shared_files.open_stream(left.column("uri")[0].as_py()) as stream, pa.ipc.open_stream(stream) as reader:
        for batch in reader:
            links = batch.column(5)
            bounds = np.asarray(links.offsets)
            at = links.values.to_numpy()[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds]) for x in (best, count)]
            columns = [*batch.columns[:4], pa.array(np.diff(bounds), pa.int64()), *map(pa.array, sums), batch.column(4)]
            parts.append(pa.record_batch(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.Table.from_batches(parts)


def document_sums(files: DataFrame, counts: DataFrame, id_type: str) -> DataFrame:
    """Per document of the files: its numbers, and sums of its links' corpus-wide counts."""
    places = files.select("file", F.posexplode("pairs").alias("place", "pair"))
    # Every pair is at most once in a file, so no pair holds more rows than there are files.
    told = places.join(counts.select("pair", "count", "is_best"), "pair").select("file", "place", "count", "is_best")
    return (
        files.select(F.col("file").alias("of"), "uri")
        .groupBy("of")
        .cogroup(told.groupBy("file"))
        .applyInArrow(
            _summed,
            f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
            "count_sum bigint, groups_sha256 string",
        )
    )


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align every text under both vocabularies and weigh its links by how often the corpus holds them."""
    files = align_files(docs, a_path, b_path, id_col, text_col)
    return document_sums(files, link_counts(files), docs.schema[id_col].dataType.simpleString())
