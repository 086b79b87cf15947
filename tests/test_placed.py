"""Tables stored by key: document joins without an exchange, hot keys apart, the same outcomes."""

import random

from pyspark.sql import functions as F

from sourcemark.operators import evidence as ev
from sourcemark.sources.placed import Placed, bundles, open_placed, store_placed


def tables(spark, hot=False):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    claims = []
    for n in range(600):
        doc = 7 if hot and n % 2 else rng.choice([*range(44), None])
        text = docs[doc][1] if doc is not None and doc < 40 else "alpha beta"
        at = rng.randrange(max(1, len(text) - 20))
        claims.append((doc, n, rng.choice([text[at : at + 20], text[at : at + 20].replace(" ", "\n "), "nowhere in it", "x"])))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(claims, "doc_id long, claim_no int, quote string")


def placed(claims, docs):
    return bundles(
        Placed("doc_id", ev.read_quotes(claims.even), ev.read_quotes(claims.hot)),
        Placed("doc_id", ev.as_sources(docs.even), ev.as_sources(docs.hot)),
        "_claims",
    )


def same(spark, tmp_path, hot):
    docs, claims = tables(spark, hot)
    stored_docs = store_placed(docs, str(tmp_path / "docs"), "doc_id", 4)
    stored_claims = store_placed(claims, str(tmp_path / "claims"), "doc_id", 4, hot_share=3, hot_rows=100)
    got = ev.place_bundles(placed(stored_claims, stored_docs), ["claim_no", "quote"])
    want = ev.resolve(claims, docs)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    return stored_claims, stored_docs


def test_outcomes_of_stored_tables(spark, tmp_path):
    claims, docs = same(spark, tmp_path, hot=False)
    assert claims.hot.where(F.col("doc_id").isNotNull()).count() == 0
    # Opened anew, the tables are the same.
    again = open_placed(spark, str(tmp_path / "claims"), "doc_id long, claim_no int, quote string", "doc_id", 4)
    assert sorted(map(str, again.rows().collect())) == sorted(map(str, claims.rows().collect()))


def test_hot_documents_are_stored_apart(spark, tmp_path):
    claims, _ = same(spark, tmp_path, hot=True)
    assert {r.doc_id for r in claims.hot.collect()} == {7, None}
    assert claims.even.where("doc_id = 7").count() == 0


def test_document_joins_exchange_nothing(spark, tmp_path):
    docs, claims = tables(spark)
    docs = store_placed(docs, str(tmp_path / "docs"), "doc_id", 4)
    claims = store_placed(claims, str(tmp_path / "claims"), "doc_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sources, quotes = ev.as_sources(docs.even), ev.read_quotes(claims.even)
        grouped = quotes.groupBy("doc_id").agg(F.collect_list(F.struct("quote", "_q", "_why")).alias("_claims"))
        plan = grouped.join(sources, "doc_id", "left")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        whole = placed(claims, docs)._jdf.queryExecution().executedPlan().toString()
        even = whole.split("Union", 1)[1].split("AQEShuffleRead")[0]
        assert "Bucketed: true" in even
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark, tmp_path):
    docs, claims = tables(spark)
    docs = store_placed(docs.limit(0), str(tmp_path / "docs"), "doc_id", 4)
    claims = store_placed(claims, str(tmp_path / "claims"), "doc_id", 4)
    got = ev.place_bundles(placed(claims, docs), ["claim_no", "quote"]).collect()
    assert len(got) == 600 and {r.reason for r in got} == {"not_found", "too_short"}
