"""Vector code compression: product quantisation with equal-average search of the codebooks.

Components become whole numbers, vectors are cut into equal parts, and each part is replaced by
the index of its nearest codebook entry. Entries are sorted by component sum; the search expands
outward from the part's own sum in both directions, and a direction ends once the squared sum gap
over the dimension strictly exceeds the best distance so far (a gap of g between the sums of two
vectors of d components means a squared distance of at least g * g / d). Ties go to the lower
index, so an entry at exactly the bound is still looked at.

A codebook round is one pass over the vectors: tasks keep sums per entry, which Spark adds up; the
driver sees one number per codebook component. All arithmetic is in whole numbers, so results
depend neither on partitioning nor on order.

Edge cases: vectors that are null, empty, or hold a null or non-finite component are dropped.
Vectors of different lengths, of a length that the parts do not divide, or with components beyond
what 64-bit arithmetic holds exactly are refused with an error. With fewer vectors than entries the
codebooks are that short. The first entries go by id (null ids last), equal ids by vector. Repeated
rows count and come back as often as they are there. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators.joins import attach
from sourcemark.session import settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Labels up to this many are joined by broadcast, more by a shuffle that deals out hot ones.
FEW_LABELS = 100_000
# Parts searched at once.
SEARCHED = 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """Entries as whole numbers, by part, index and position, and the scale that made them whole."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components present and finite."""
    # A number times zero is zero; infinities and not-a-number are not.
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(x * 0 == 0, F.lit(False))), F.lit(False))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("vec_id"), vector.alias("vector"), *others).where(finite(F.col("vector")))


def whole(batch: pa.Array, dimension: int, parts: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a batch of vectors, by row, part and position."""
    bounds = np.asarray(batch.offsets)
    if (np.diff(bounds) != dimension).any():
        raise ValueError(f"vectors of lengths other than {dimension}")
    values = batch.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    scaled = np.floor(values * scale)
    # Squared distances of whole vectors, and best distances times a part's dimension, stay exact.
    limit = isqrt(2**62 // (dimension * max(dimension // parts, 1))) // 2
    if len(scaled) and np.abs(scaled).max() > limit:
        raise ValueError(f"components beyond {limit / scale} in size have no exact code")
    return scaled.astype(np.int64).reshape(-1, parts, dimension // parts)


class EqualAverageSearch:
    """Nearest entries of many parts at once."""

    def __init__(self, books: Codebooks):
        entries = books.entries
        self.count, self.width = entries.shape[1:]
        sums = entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)
        self.sorted = np.take_along_axis(entries, self.order[:, :, None], axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance per row and part."""
        step = max(1, SEARCHED // vectors.shape[1])
        found = [self._nearest(vectors[i : i + step]) for i in range(0, len(vectors), step)]
        if not found:
            return (np.zeros(vectors.shape[:2], dtype=np.int64),) * 2
        return tuple(np.concatenate(side) for side in zip(*found, strict=True))

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, parts, width = vectors.shape
        own = vectors.sum(axis=2)
        start = np.stack([np.searchsorted(self.sums[p], own[:, p]) for p in range(parts)], axis=1).ravel()
        points, own = vectors.reshape(-1, width), own.ravel()
        part = np.tile(np.arange(parts), rows)
        # The first look is at the entry of the nearest sum above, or the last one.
        at = np.minimum(start, self.count - 1)
        best = ((points - self.sorted[part, at]) ** 2).sum(axis=1)
        code = self.order[part, at]
        upward = np.arange(len(points)), 1
        downward = np.arange(len(points)), -1
        above, below = at + 1, at - 1
        while len(upward[0]) or len(downward[0]):
            upward = self._look(upward, above, points, own, part, best, code)
            downward = self._look(downward, below, points, own, part, best, code)
        return code.reshape(rows, parts), best.reshape(rows, parts)

    def _look(self, side, place, points, own, part, best, code):
        """One step of a direction for the parts whose bound still allows it."""
        who, step = side
        at = place[who]
        inside = (at >= 0) & (at < self.count)
        who, at = who[inside], at[inside]
        gap = self.sums[part[who], at] - own[who]
        near = gap * gap <= best[who] * self.width
        who, at = who[near], at[near]
        distance = ((points[who] - self.sorted[part[who], at]) ** 2).sum(axis=1)
        index = self.order[part[who], at]
        better = (distance < best[who]) | ((distance == best[who]) & (index < code[who]))
        best[who[better]], code[who[better]] = distance[better], index[better]
        place[who] += step
        return who, step


def _entry_sums(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's vectors summed per entry: a row per component of every entry in use."""
    search = EqualAverageSearch(books)
    parts, count, width = books.entries.shape
    used = np.zeros(parts * count, dtype=np.int64)
    sums = np.zeros((parts * count, width), dtype=np.int64)
    for batch in batches:
        vectors = whole(batch.column(0), books.dimension, parts, books.scale)
        codes, _ = search.nearest(vectors)
        place = (codes + np.arange(parts) * count).ravel()
        used += np.bincount(place, minlength=parts * count)
        order = np.argsort(place, kind="stable")
        met, first = np.unique(place[order], return_index=True)
        if len(met):
            sums[met] += np.add.reduceat(vectors.reshape(-1, width)[order], first, axis=0)
    met = np.flatnonzero(used)
    yield pa.record_batch(
        [
            pa.array(np.repeat(met, width)),
            pa.array(np.tile(np.arange(width), len(met))),
            pa.array(np.repeat(used[met], width)),
            pa.array(sums[met].ravel()),
        ],
        ["entry", "position", "n", "total"],
    )


def first_codebooks(
    vectors: DataFrame, parts: int, entries: int, scale: int, id_col: str, vector_col: str
) -> Codebooks | None:
    """Codebooks of the parts of the vectors with the smallest ids; None if there are no vectors."""
    kept = _kept(vectors, id_col, vector_col)
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return None
    dimension = len(rows[0].vector)
    if dimension % parts:
        raise ValueError(f"{parts} equal parts of {dimension} components")
    start = whole(pa.array([r.vector for r in rows], pa.list_(pa.float64())), dimension, parts, scale)
    return Codebooks(start.transpose(1, 0, 2).copy(), scale)


def fit_codebooks(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Codebooks | None:
    """Codebooks fitted to all vectors; every round is one pass that moves entries to their parts' mean."""
    books = first_codebooks(vectors, parts, entries, scale, id_col, vector_col)
    if books is None:
        return None
    data = _kept(vectors, id_col, vector_col).select("vector")
    for _ in range(rounds):
        now = books
        sums = data.mapInArrow(
            lambda batches, books=now: _entry_sums(books, batches),
            "entry bigint, position bigint, n bigint, total bigint",
        )
        # As many rows as the codebooks have components, whatever the number of vectors.
        totals = sums.groupBy("entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        flat = now.entries.reshape(-1, now.entries.shape[2]).copy()
        for row in totals:
            flat[row.entry, row.position] = row.total // row.n
        books = Codebooks(flat.reshape(now.entries.shape), scale)
    return books


def _codes(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = EqualAverageSearch(books)
    digits = max(2, (len(f"{books.entries.shape[1] - 1:x}") + 1) // 2 * 2)
    kind = {2: ">u1", 4: ">u2"}.get(digits, ">u4")
    for batch in batches:
        vectors = whole(batch.column(1), books.dimension, books.entries.shape[0], books.scale)
        codes, distances = search.nearest(vectors)
        texts = [row.tobytes().hex() for row in codes.astype(kind)]
        yield pa.record_batch(
            [batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(distances.sum(axis=1))],
            ["vec_id", "label", "code", "error"],
        )


def encode(
    vectors: DataFrame,
    books: Codebooks | None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, label, code (two hex digits an index, more for codebooks over 256 entries) and squared error."""
    kept = _kept(vectors, id_col, vector_col, F.col(label_col).alias("label"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"
    if books is None:
        return kept.sparkSession.createDataFrame([], schema)
    return kept.mapInArrow(lambda batches: _codes(books, batches), schema)


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that each code names, in the scale of the vectors."""
    digits = max(2, (len(f"{books.entries.shape[1] - 1:x}") + 1) // 2 * 2)
    tables = F.lit((books.entries / books.scale).tolist())
    part = lambda i: F.conv(F.substring(code_col, i * digits + 1, digits), 16, 10).cast("int") + 1
    pieces = [F.element_at(F.element_at(tables, i + 1), part(i)) for i in range(books.entries.shape[0])]
    return codes.withColumn("vector", F.flatten(F.array(*pieces)))


def label_errors(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of the same label (nulls together)."""
    key = F.struct(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"), F.col("label").isNull().alias("none"))
    rows = coded.withColumn("_key", key)
    totals = settle(rows.groupBy("_key").agg(F.sum("error").alias("label_error")))
    if totals.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(totals), "_key").drop("_key")
    return attach(rows, totals, ["_key"]).drop("_key")


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Fit codebooks to all vectors and encode them: vec_id, code, error, label_error, codebooks_sha256."""
    books = fit_codebooks(vectors, parts, entries, rounds, scale, id_col, vector_col)
    coded = label_errors(encode(vectors, books, id_col, vector_col, label_col))
    digest = books.sha256() if books else None
    return coded.select(
        "vec_id", "code", "error", F.col("label_error").cast("bigint").alias("label_error"), F.lit(digest).alias("codebooks_sha256")
    )


def _assigned(name: str, books: str) -> str:
    """Distance and index in one number, so the least is the nearest entry of the lowest index."""
    return f"""{name} AS (
    SELECT q.r, q.p, min(((q.a-e.a)*(q.a-e.a) + (q.b-e.b)*(q.b-e.b) + (q.c-e.c)*(q.c-e.c) + (q.d-e.d)*(q.d-e.d)) * 64 + e.e) AS k
    FROM q JOIN {books} e ON q.p = e.p GROUP BY q.r, q.p)"""


def _moved(name: str, books: str, assigned: str) -> str:
    means = ", ".join(f"CAST(floor(sum(q.{c})::DOUBLE / count(*)) AS BIGINT) AS {c}" for c in "abcd")
    return f"""{name} AS (
    SELECT o.p, o.e, {', '.join(f'coalesce(n.{c}, o.{c}) AS {c}' for c in 'abcd')}
    FROM {books} o LEFT JOIN (
        SELECT q.p, w.k % 64 AS e, {means} FROM q JOIN {assigned} w ON q.r = w.r AND q.p = w.p GROUP BY q.p, w.k % 64
    ) n ON o.p = n.p AND o.e = n.e)"""


def oracle_sql() -> str:
    """The same by comparing every part with every entry (64 components, 16 parts, 64 entries)."""
    component = "CAST(floor(256 * CAST(embedding[4 * t.p + {}] AS DOUBLE)) AS BIGINT) AS {}"
    steps = [
        """kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"""q AS (SELECT r, t.p, {', '.join(component.format(i + 1, c) for i, c in enumerate('abcd'))}
    FROM kept, range(0, 16) t(p))""",
        "e0 AS (SELECT p, r - 1 AS e, a, b, c, d FROM q WHERE r <= 64)",
        _assigned("w0", "e0"),
        _moved("e1", "e0", "w0"),
        _assigned("w1", "e1"),
        _moved("e2", "e1", "w1"),
        _assigned("w2", "e2"),
        """coded AS (SELECT r, string_agg(printf('%02x', CAST(k % 64 AS BIGINT)), '' ORDER BY p) AS code,
    CAST(sum(k // 64) AS BIGINT) AS error FROM w2 GROUP BY r)""",
        "digest AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS h FROM e2)",
    ]
    return f"""WITH {', '.join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT h FROM digest) AS codebooks_sha256
FROM coded JOIN kept ON coded.r = kept.r"""
