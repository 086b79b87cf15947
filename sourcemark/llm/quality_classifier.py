"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed n-grams are counted: one of target text (a labelled sample of good
documents), one of the raw corpus (all documents). A document's log weight is the sum over its
n-grams of log(target) - log(raw); its score is that sum over its n-grams plus ``PRIOR``, so that a
few odd signs do not sink a short text. Scores are perturbed with Gumbel noise drawn from a hash
of the id, and the ``k`` highest are kept: a draw without replacement in proportion to
exp(``SHARPNESS`` * score).

n-grams are three consecutive bytes (case and signs as they are) and, as the n-gram of a
repetition, whether a word equals the one before it.

``k`` is the number of documents whose perturbed score is above a cut. The cut is fitted on the
perturbed scores of labelled rows that the target model has not seen: of the cuts that lose at most
``LOSS`` of the good ones, one that keeps the fewest bad ones, and of these one that loses the fewest
good ones. Toxic rows are bad ones, whatever their quality.

Scale: the raw model is counted over all documents in one pass, each task sending its bucket sums;
the models have ``BUCKETS`` rows. The labelled sample has at most ``SAMPLE`` rows per label, so it
is broadcast. The k-th highest score is found by counting score digits, at most 65,536 at a time,
never by sorting documents.

Edge cases: a null or empty text has no n-gram and is rejected. Null labels are ignored, but a toxic
row needs no quality; of several labels of one document the worst counts. Without a labelled good document nothing is
rejected but texts without n-grams. Documents of one id and one text share score and noise, and
ties at the k-th place are all kept. Extra columns are ignored by ``score`` and kept by
``resample``. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import settle
from sourcemark.llm.hashing import NOT_SPACE, mix, pieces, word_hashes
from sourcemark.llm.vocabulary import forget

BUCKETS = 1 << 14
SAMPLE = 20_000
PRIOR = 200.0
SHARPNESS = 200.0
# Share of held-out good documents that the cut may lose, and the share of documents of quality 0 that tests let pass.
LOSS = 0.005
LEAK = 0.05
SMOOTH = 1.0
SEED = 2
# Buckets of the two word relations, behind those of the byte n-grams.
FRESH, AGAIN = BUCKETS, BUCKETS + 1
# Perturbed scores as whole numbers: digits of 16 bits, the highest first.
SCALE, OFFSET, LARGEST = 1e9, 1 << 46, (1 << 47) - 1
DIGITS = (32, 16, 0)


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a batch: byte buckets, bounds per text; repeated-word flags, bounds per text."""
    for _, data, bounds in pieces(texts):
        words, ends = word_hashes(data, bounds, NOT_SPACE)
        again = np.zeros(len(words), dtype=bool)
        again[1:] = words[1:] == words[:-1]
        again[ends[:-1][ends[:-1] < len(words)]] = False
        wide = data.astype(np.uint32)
        grams = np.zeros(len(wide), dtype=np.uint32)
        if len(wide) > 2:
            grams[:-2] = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))
        yield (grams * np.uint32(0x27D4EB2F)) >> np.uint32(18), bounds, again, ends


def _rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, int, int]]:
    """Per text: buckets of its byte n-grams, and how many words are fresh and repeated."""
    for grams, bounds, again, ends in ngrams(texts):
        repeats = np.concatenate([[0], np.cumsum(again)])
        for first, last, a, b in zip(bounds[:-1], bounds[1:], ends[:-1], ends[1:], strict=True):
            twice = int(repeats[b] - repeats[a])
            yield grams[first : max(first, last - 2)], int(b - a) - twice, twice


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket sums of one task: raw over all rows, target over the marked ones."""
    forget()
    sums = np.zeros((2, BUCKETS + 2), dtype=np.int64)
    for batch in batches:
        for (grams, fresh, twice), target in zip(_rows(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(grams, minlength=BUCKETS)
            for kind in (0, 1) if target else (0,):
                sums[kind, :BUCKETS] += found
                sums[kind, FRESH] += fresh
                sums[kind, AGAIN] += twice
    for kind in (0, 1):
        buckets = np.flatnonzero(sums[kind])
        yield pa.record_batch(
            [pa.array(np.full(len(buckets), kind), pa.int32()), pa.array(buckets, pa.int32()), pa.array(sums[kind, buckets])],
            ["kind", "bucket", "n"],
        )


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * len(n)))
    return share(target) - share(raw)


@dataclass(frozen=True)
class Model:
    """Log ratios per bucket, and the least key that is kept (None: not drawn yet)."""

    ratios: np.ndarray
    least: int | None = None


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` good and ``sample`` other documents: ``id, good, held`` (out of the target)."""
    worst = (
        labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic <> 0)")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min(F.expr("coalesce(quality, 0) > 0 AND coalesce(toxic, 0) = 0").cast("int")).alias("good"))
    )
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    good = worst.where("good = 1").orderBy(order, "id").limit(sample)
    bad = worst.where("good = 0").orderBy(order, "id").limit(sample)
    return good.unionByName(bad).select("id", (F.col("good") == 1).alias("good"), (F.pmod(order, F.lit(2)) == 0).alias("held"))


def _with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"), "left")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Count both models over all of ``docs``."""
    marked = _with_sample(docs, labelled_sample(labels, sample))
    target = F.coalesce(F.col("good") & ~F.col("held"), F.lit(False)).alias("target")
    counts = (
        marked.select("text", target).mapInArrow(_counted, "kind int, bucket int, n bigint")
        .groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    )
    sums = np.zeros((2, BUCKETS + 2))
    for row in counts.toLocalIterator():  # at most two rows per bucket
        sums[row["kind"], row["bucket"]] = row["n"]
    ratios = np.zeros(BUCKETS + 2)
    if sums[1].sum() > 0:
        # Byte n-grams and word relations are two distributions.
        for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
            ratios[part] = _log_ratio(sums[1, part], sums[0, part])
    return Model(ratios)


def _noise(hashes: np.ndarray) -> np.ndarray:
    uniform = (mix(hashes.view(np.uint64)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((uniform + 0.5) / float(1 << 53)))


def _scores(model: Model, texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams, log weight, score and the key that orders the draw, of each text."""
    counts, weights = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for i, (grams, fresh, twice) in enumerate(_rows(texts)):
        counts[i] = len(grams) + fresh + twice
        weights[i] = model.ratios[grams].sum() + fresh * model.ratios[FRESH] + twice * model.ratios[AGAIN]
    score = weights / (counts + PRIOR)
    drawn = np.floor((SHARPNESS * score + _noise(hashes)) * SCALE)
    keys = np.clip(drawn + OFFSET, 0, LARGEST).astype(np.int64)
    keys[counts == 0] = -1
    return counts, weights, score, keys


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        found = _scores(model, batch.column(1), batch.column(2).to_numpy())
        yield pa.record_batch(
            [batch.column(0), *map(pa.array, found), *batch.columns[3:]],
            ["doc_id", "n_ngrams", "log_weight", "score", "key", "good", "held"],
        )


def score(docs: DataFrame, model: Model, sample: DataFrame) -> DataFrame:
    """Per document: ``n_ngrams, log_weight, score, key`` and its label, if it is in the sample."""
    rows = _with_sample(docs, sample)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", _seeded().alias("noise"), "good", "held").mapInArrow(
        lambda it: _scored(model, it),
        f"doc_id {id_type}, n_ngrams bigint, log_weight double, score double, key bigint, good boolean, held boolean",
    )


def _seeded():
    return F.xxhash64(F.lit(SEED), F.col("doc_id"))


def best_cut(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The cut that lets in the fewest bad documents, of those that lose at most ``loss`` of the good."""
    if not len(good) or not len(bad):
        return -np.inf
    points = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (points[1:] + points[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts)
    let_in = len(bad) - np.searchsorted(np.sort(bad), cuts)
    allowed = lost <= loss * len(good)
    return float(cuts[np.lexsort((lost[allowed], let_in[allowed]))[0]])


def kth_key(scored: DataFrame, k: int) -> int:
    """The k-th highest key, exactly: its digits are found one after the other by counting."""
    prefix, left = 0, k
    for shift in DIGITS:
        inside = scored.where(F.shiftright("key", shift + 16) == prefix)
        digit = F.shiftright("key", shift).bitwiseAND(0xFFFF)
        counts = inside.groupBy(digit.alias("digit")).count().collect()  # at most 65,536 rows
        for value, count in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if left <= count:
                break
            left -= count
        prefix = (prefix << 16) | value
    return prefix


def draw(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Model]:
    """Scores of all documents, and the model with the least key that is kept."""
    known = settle(labelled_sample(labels, sample))
    model = fit(docs, labels, sample)
    scored = settle(score(docs, model, known))
    held = scored.where("key >= 0 AND (NOT good OR held)").select("good", "key").toPandas()  # at most 2 * sample ids
    cut = best_cut(held["key"][held["good"]].to_numpy(), held["key"][~held["good"]].to_numpy())
    able = scored.where("key >= 0")
    k = able.where(F.col("key") >= F.lit(cut)).count()
    return scored, Model(model.ratios, kth_key(able, k) if k else LARGEST + 1)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: ``doc_id, n_ngrams, log_weight, score, kept``."""
    scored, model = draw(docs, labels, sample)
    return scored.select("doc_id", "n_ngrams", "log_weight", "score", (F.col("key") >= model.least).alias("kept"))


def _kept(model: Model, text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _scores(model, batch.column(text), batch.column(batch.num_columns - 1).to_numpy())[3]
        yield batch.drop_columns(["noise"]).filter(pa.array(keys >= model.least))


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with all their columns."""
    _, model = draw(docs, labels, sample)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _seeded()).toDF(*names, "noise")
    text = docs.columns.index("text")
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(lambda it: _kept(model, text, it), schema).toDF(*docs.columns)
