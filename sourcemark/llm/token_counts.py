"""Token counts by byte-pair merging, without emitting identifiers.

A word starts as one symbol per byte. The adjacent pair of lowest rank is popped from a heap again
and again and merged in a linked list of symbols; the count is the initial symbols less the
merges. Words repeat, so each worker keeps the counts of the words it met in a bounded cache.

The split into words follows the vocabulary file: special strings first, then composition (NFC),
lower case, and runs of letters, single digits, runs of other signs and English contractions.

Edge cases: a null or empty text, or one of white space only, has 0 tokens. Texts of any length
are worked on in blocks that end at white space. Repeated rows give repeated rows, extra columns
are ignored, an empty table gives an empty table, a null id stays null.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.vocabulary import Cutter, WordCache, blocks, kept, shared_file, split_words

LIMIT = 2048

class Merger:
    """Counts what the merges of one vocabulary leave of a word."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        self.cutter = Cutter(vocabulary)
        self.pieces: dict[str, int] = {}
        self.words = WordCache(lambda words: map(self.count, words))

    def merged(self, piece: str) -> int:
        """Symbols left of one piece once no pair can be merged."""
        symbols: list = list(piece)
        symbols[-1] += self.end
        count = len(symbols)
        if count == 1:
            return 1
        ranks = self.ranks
        heap = []
        for i in range(count - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # Stale unless both neighbours still form the pair of that rank.
            if symbols[i] is None or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks.get((symbols[i], symbols[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], symbols[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, h))
        return count - merges

    def _plain(self, word: str) -> int:
        total = 0
        for piece in self.cutter.pieces(word):
            count = self.pieces.get(piece)
            if count is None:
                count = self.merged(piece)
                if len(piece) <= 32:
                    if len(self.pieces) > 300_000:
                        self.pieces.clear()
                    self.pieces[piece] = count
            total += count
        return total

    def count(self, word: str) -> int:
        """Tokens of a run without white space."""
        parts = self.cutter.parts(word)
        return len(parts) // 2 + sum(self._plain(part) for part in parts[::2] if part)


def _counts(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merger = kept(("counts", vocabulary.value), lambda: Merger(vocabulary.value))
    for batch in batches:
        tokens = [
            0 if text is None else sum(sum(merger.words.lookup(split_words(block))) for block in blocks(text))
            for text in (value.as_py() for value in batch.column(1))
        ]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: UTF-8 bytes, tokens under the vocabulary at ``path``, and whether over ``limit``."""
    vocabulary = shared_file(docs.sparkSession, path)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(
        lambda batches: _counts(vocabulary, batches), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
