"""The classifier against a plain recount and on held-out labels; the pipeline stage by stage."""

import math
from collections import Counter

import numpy as np
import pytest
from fixtures import no_documents, odd_documents, odd_texts, sentence
from pyspark.sql import functions as F

import corpus_pipeline
from sourcemark.llm import quality_classifier as qc


def plain_ngrams(text: str | None) -> Counter:
    data = (text or "").encode()
    out: Counter = Counter()
    for i in range(len(data) - 2):
        h = (data[i] * 0x9E3779B1) ^ (data[i + 1] * 0x85EBCA6B) ^ (data[i + 2] * 0xC2B2AE35)
        out[((h & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 18] += 1
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    for i, word in enumerate(words):
        out[qc.AGAIN if i and words[i - 1] == word else qc.FRESH] += 1
    return out


def junk(seed: int) -> str:
    return " ".join(w + "***" for w in sentence(seed, 40).split())


def labelled(spark):
    rows = [(i, sentence(i, 40 + i % 60) if i % 5 else junk(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (1, None, 0), (4, 1, 1), (2, 1, None)]
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_weights_are_those_of_a_plain_recount(spark):
    docs, labels = labelled(spark)
    sample = {r.id: r for r in qc.labelled_sample(labels).collect()}
    target, raw = Counter(), Counter()
    for r in docs.collect():
        grams = plain_ngrams(r.text)
        raw.update(grams)
        if r.doc_id in sample and sample[r.doc_id].good and not sample[r.doc_id].held:
            target.update(grams)

    def share(counts, gram):
        side = range(qc.BUCKETS) if gram < qc.BUCKETS else (qc.FRESH, qc.AGAIN)
        return math.log((counts[gram] + 1) / (sum(counts[g] for g in side) + len(side)))

    got = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    for r in docs.where("doc_id < 12").collect():
        grams = plain_ngrams(r.text)
        weight = sum(n * (share(target, g) - share(raw, g)) for g, n in grams.items())
        assert got[r.doc_id].n_ngrams == sum(grams.values())
        assert got[r.doc_id].log_weight == pytest.approx(weight, rel=1e-9, abs=1e-9)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    rows = qc.classify(docs, labels).collect()
    assert all(r.kept for r in rows if r.doc_id % 5)
    let_in = sum(r.kept for r in rows if r.doc_id % 5 == 0)
    assert let_in <= 2 * qc.LEAK * 80
    kept = qc.resample(docs.withColumn("noise", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "noise"]
    assert kept.count() == 320 + let_in


def test_kth_key_is_exact(spark):
    keys = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 47, 500)] + [12345] * 20
    frame = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for k in (1, 7, 250, 499, 505, 520):
        assert qc.kth_key(frame, k) == sorted(keys, reverse=True)[k - 1]


def test_cuts():
    good, bad = np.array([0.0, 0.1, 0.2]), np.array([-1.0, -0.9, -0.8])
    assert -0.8 < qc.best_cut(good, bad) < 0.0
    assert qc.best_cut(good, np.array([])) == qc.best_cut(np.array([]), bad) == -np.inf


def test_cuts_lose_no_more_good_ones_than_stated():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0, 1, 2000), draw.normal(-3, 1, 500)
    cut = qc.best_cut(good, bad)
    assert 0 < (good < cut).mean() <= qc.LOSS
    assert (bad >= cut).sum() == min((bad >= c).sum() for c in np.sort(good)[: int(qc.LOSS * 2000) + 1])
    # No bad one is let in where a cut without error exists.
    assert (np.linspace(-9, -1, 100) >= qc.best_cut(np.linspace(0, 1, 100), np.linspace(-9, -1, 100))).sum() == 0


def test_toxic_rows_are_bad_ones(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, 1), (5, None, None), (6, 1, None), (6, 1, 1), (7, 1, None)]
    sample = qc.labelled_sample(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {r.id: r.good for r in sample.collect()} == {1: True, 2: False, 3: False, 4: False, 6: False, 7: True}


def test_kept_rates_of_labelled_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.classify(docs, labels).join(labels, "doc_id").selectExpr(
        "kept", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS kind"
    )
    rates = {r.kind: r.rate for r in rows.groupBy("kind").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates["good"] >= 0.99
    assert rates["bad"] <= 0.01
    assert rates["toxic"] <= 0.85


def test_odd_documents_and_empty_tables(spark):
    docs, labels = odd_documents(spark), labelled(spark)[1]
    rows = qc.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    nothing = [r for r in rows if r.n_ngrams == 0]
    assert len(nothing) == 3 and not any(r.kept for r in nothing)
    none = labels.limit(0)
    assert qc.resample(docs, none).count() == docs.where("length(text) > 0").count() - 1 + sum(1 for t in odd_texts() if t == " \n\t ")
    assert qc.classify(no_documents(spark), labels).count() == 0
    assert qc.resample(no_documents(spark), none).columns == docs.columns


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.withColumn("kept", F.lit(True)).withColumn("_id", F.lit("x"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf_dir)
        assert out.columns == extra.columns, name
        assert out.select("doc_id").subtract(extra.select("doc_id")).count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir).select("doc_id").distinct().join(labels, "doc_id")
    clean, junked = labels.where("quality = 1 and toxic = 0").count(), labels.where("quality = 0").count()
    assert kept.where("quality = 1 and toxic = 0").count() >= 0.97 * clean
    assert kept.where("quality = 0").count() <= 0.5 * junked
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(last.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
