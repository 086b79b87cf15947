"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one suffix automaton that is restarted at every item, so
no match crosses two items. Document words are streamed through it; the state and the length of
the longest match ending at each word say which windows of ten consecutive item words end there,
and all words of such a match are hit. An item of fewer than ten words is one window.

Scale: documents are never moved. An automaton holds at most ``BLOCK_WORDS`` item words, which
bounds its broadcast; a larger benchmark is dealt over several automata. These then pass over a
written copy of the documents one after the other, and their spans are united per row before
coverage is judged and anything is cut; rows that were cut pass again until nothing is. Items
longer than a chunk are cut into chunks that overlap by a window less one word.

Edge cases: a null or empty text has no words and is never hit; null or empty items have no
window; items with a null id are matched but not listed. Repeated items or rows change nothing
but the number of rows. An empty benchmark hits nothing. Extra columns are ignored by ``scan``
and kept by ``remove_contamination``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import free_name, settle
from sourcemark.llm.vocabulary import kept

WINDOW = 10
BLOCK_WORDS = 200_000
CHUNK_WORDS = 20_000
# A document with at least this share of hit words is removed whole.
COVERAGE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same over UTF-8 bytes of lower-cased text.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton:
    """Suffix automaton over the words of several items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: list[set] = [set() for _ in self.next]
        self.shorts: list[tuple] = [()] * len(self.next)
        for name, words in items:
            self._mark(name, words)
        # The state of the last ``window`` words of a state, and all short items that end at it.
        self.window_state = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[state] >= window:
                self.window_state[state] = state if self.length[above] < window else self.window_state[above]
            self.shorts[state] += self.shorts[above]

    def _extend(self, last: int, word: bytes) -> int:
        following = self.next[last].get(word)
        if following is not None:
            if self.length[following] == self.length[last] + 1:
                return following
            return self._split(last, word, following)
        state = self._new(self.length[last] + 1, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            following = self.next[last][word]
            exact = self.length[following] == self.length[last] + 1
            self.link[state] = following if exact else self._split(last, word, following)
        return state

    def _new(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, last: int, word: bytes, state: int) -> int:
        """The shorter strings of ``state`` get a state of their own."""
        clone = self._new(self.length[last] + 1, dict(self.next[state]))
        self.link[clone], self.link[state] = self.link[state], clone
        while last >= 0 and self.next[last].get(word) == state:
            self.next[last][word] = clone
            last = self.link[last]
        return clone

    def _mark(self, name: str | None, words: list[bytes]) -> None:
        state = 0
        if len(words) < self.window:
            for word in words:
                state = self.next[state][word]
            self.shorts[state] += ((len(words), name),)
            return
        length = 0
        for word in words:
            state = self.next[state][word]
            length += 1
            at = state
            while self.length[self.link[at]] >= self.window:
                at = self.link[at]
            if length >= self.window:
                self.items[at].add(name)

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [first, last] of hit words, in order, and the names of the items found."""
        following, link, length, shorts, window = self.next, self.link, self.length, self.shorts, self.window
        spans: list[list[int]] = []
        states: set = set()
        names: set = set()
        state = run = 0
        for i, word in enumerate(words):
            to = following[state].get(word)
            if to is not None:
                run += 1
            else:
                while state and to is None:
                    state = link[state]
                    to = following[state].get(word)
                if to is None:
                    run = 0
                    continue
                run = length[state] + 1
            state = to
            if run >= window:
                states.add(self.window_state[state])
                _add(spans, i - run + 1, i)
            if shorts[state]:
                for size, name in shorts[state]:
                    if size <= run:
                        names.add(name)
                        _add(spans, i - size + 1, i)
        for found in states:
            names |= self.items[found]
        return spans, names


def _add(spans: list[list[int]], first: int, last: int) -> None:
    while spans and spans[-1][0] >= first:
        spans.pop()
    if spans and spans[-1][1] >= first - 1:
        spans[-1][1] = max(last, spans[-1][1])
    else:
        spans.append([first, last])


def _item_blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """The items dealt over blocks of about ``block_words`` words, each broadcast by itself."""
    spark = benchmark.sparkSession
    step = CHUNK_WORDS - (window - 1)
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))))
        .select("item", F.slice("words", F.col("at") + 1, CHUNK_WORDS).alias("words"))
    )
    items = settle(items)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(1, -(-total // block_words))
    deal = F.pmod(F.xxhash64("words"), F.lit(count))
    return [
        spark.sparkContext.broadcast(
            (
                uuid.uuid4().hex,
                [(row["item"], [w.encode() for w in row["words"]]) for row in items.where(deal == b).toLocalIterator()],
            )
        )
        for b in range(count)
    ]


def _automaton(block, window: int) -> Automaton:
    name, items = block.value
    return kept(("automaton", name, window), lambda: Automaton(items, window))


def words_of(text: bytes | None) -> list[bytes]:
    return WORD_BYTES.findall(text.lower()) if text else []


def _found(block, window: int, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(block, window)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        counts, spans, names = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = words_of(text.as_py())
            found, items = automaton.match(words)
            counts.append(len(words))
            spans.append([{"first": a, "last": b} for a, b in found])
            names.append([name for name in items if name is not None])
        yield pa.record_batch(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))],
            [key, "n_words", "spans", "items"],
        )


_FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _united(parts: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""

    def add(done: Column, span: Column) -> Column:
        top = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(
            joins,
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.aggregate(F.array_sort(parts), empty, add)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``n_words``, the ``spans`` of hit words and the ``items`` whose windows occur."""
    blocks = _item_blocks(benchmark, window, block_words)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        block = blocks[0]
        return rows.mapInArrow(lambda it: _found(block, window, it, "doc_id"), f"doc_id {id_type}, {_FOUND}")
    written = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    merged = _merged(written, blocks, window)
    return written.select("doc_id", "row").join(merged, "row").drop("row")


def _merged(rows: DataFrame, blocks: list, window: int, hit_only: bool = False) -> DataFrame:
    """What all ``blocks`` find in ``rows`` (row, text), united per row; ``hit_only``: only rows with spans."""

    def one_pass(block) -> DataFrame:
        found = rows.select("row", "text").mapInArrow(lambda it: _found(block, window, it, "row"), f"row bigint, {_FOUND}")
        return settle(found.where(F.size("spans") > 0) if hit_only else found)

    passes = [one_pass(block) for block in blocks]
    merged = passes[0]
    for other in passes[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        _united(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and item digest of each scanned document."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cleaned(text: bytes, automaton: Automaton, min_words: int, coverage: float) -> bytes | None:
    """``text`` without spans of ``min_words`` hit words or more; None if too much of it is hit.

    Cutting can bring new matches together, so it goes on until none is left.
    """
    found_before = False
    while True:
        places = [m.span() for m in WORD_BYTES.finditer(text.lower())]
        lowered = text.lower()
        spans, _ = automaton.match([lowered[a:b] for a, b in places])
        hit = sum(b - a + 1 for a, b in spans)
        if places and not found_before and hit >= coverage * len(places):
            return None
        spans = [s for s in spans if s[1] - s[0] + 1 >= min_words]
        if not spans:
            return text
        found_before = True
        text = _without(text, places, spans)


def _without(text: bytes, places: list[tuple[int, int]], spans: list) -> bytes:
    """``text`` without the words of ``spans`` and what lies between them."""
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    out.append(text[at:])
    return b"".join(out)


def _clean(block, window, min_words, coverage, column, batches) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(block, window)
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.binary())
        out = []
        for text in texts:
            text = text.as_py()
            keep = text is None or not automaton.match(words_of(text))[0]
            out.append((True, text) if keep else (False, cleaned(text, automaton, min_words, coverage)))
        stays = pa.array([same or text is not None for same, text in out])
        new = pa.array([text for _, text in out], pa.binary()).cast(pa.string())
        flag = pa.array([not same for same, _ in out])
        arrays = [*batch.columns]
        arrays[at] = new
        yield pa.record_batch([*arrays, flag], [*batch.schema.names, "changed"]).filter(stays)


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_words: int = 1,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without hit spans of at least ``min_words`` words and without documents hit to ``coverage``.

    All columns stay; ``n_chars``, where there is one, counts the new text. With several automata the
    spans of all of them are united before they are judged and cut, as one automaton would find them.
    """
    blocks = _item_blocks(benchmark, window, block_words)
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered, column = docs.toDF(*names), names[docs.columns.index("text")]
    if len(blocks) == 1:
        schema = ", ".join(f"{n} {numbered.schema[n].dataType.simpleString()}" for n in names)
        out = numbered.mapInArrow(
            lambda it: _clean(blocks[0], window, min_words, coverage, column, it), f"{schema}, changed boolean"
        )
    else:
        numbered = settle(numbered.withColumn("row", F.monotonically_increasing_id()))
        new = _cut_by_all(numbered.select("row", F.col(column).alias("text")), blocks, window, min_words, coverage)
        new = new.select("row", F.col("text").alias("new"), F.lit(True).alias("changed"))
        out = numbered.join(new, "row", "left").where("changed IS NULL OR new IS NOT NULL")
        out = out.withColumn(column, F.when(F.col("changed"), F.col("new")).otherwise(F.col(column)))
        out = out.select(*names, F.coalesce("changed", F.lit(False)).alias("changed"))
    flag = free_name(docs, "_changed_")
    out = out.toDF(*docs.columns, flag)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(flag), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.drop(flag)


def _cut_by_all(rows: DataFrame, blocks: list, window: int, min_words: int, coverage: float) -> DataFrame:
    """The hit ones of ``rows`` (row, text) with their last text; null if too much of it was hit.

    Cutting can bring new matches of any automaton together, so rows that were cut go through all again.
    """
    done, first = None, True
    while True:
        hit = rows.join(_merged(rows, blocks, window, hit_only=True).select("row", "spans"), "row")
        limit = coverage if first else None
        after = settle(
            hit.select("row", "text", "spans").mapInArrow(
                lambda it, limit=limit: _cut(min_words, limit, it), "row bigint, text string, again boolean"
            )
        )
        # A row that goes round again is final only in the round that cuts it no more, hit or not.
        last = after.select("row", "text")
        done = last if done is None else done.join(last.select("row"), "row", "left_anti").unionByName(last)
        rows, first = after.where("again").select("row", "text"), False
        if rows.isEmpty():
            return done


def _cut(min_words: int, coverage: float | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans of ``min_words`` words or more; null from ``coverage`` on."""
    for batch in batches:
        texts, again = [], []
        for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            places = [m.span() for m in WORD_BYTES.finditer(text.lower())]
            spans = [(s["first"], s["last"]) for s in found]
            if coverage is not None and sum(b - a + 1 for a, b in spans) >= coverage * len(places):
                texts.append(None)
                again.append(False)
                continue
            spans = [(a, b) for a, b in spans if b - a + 1 >= min_words]
            texts.append(_without(text, places, spans))
            again.append(bool(spans))
        yield pa.record_batch(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(again)], ["row", "text", "again"]
        )


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark
),
iw AS (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS k, array_to_string(words[i:i + least(len(words), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT rid, k, i, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM d, sizes WHERE len(words) >= k)
),
m AS (SELECT dw.rid, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
its AS (
  SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM m GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)"""
