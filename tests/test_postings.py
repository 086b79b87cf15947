"""Stored postings: the same ranking as over texts, deltas, removals, replays, and a plan without texts."""

import random

from sourcemark.operators import retrieval as rt
from sourcemark.operators.postings import PostingStore, _shard


def corpus(count=80, seed=1):
    rng = random.Random(seed)
    words = ["ab", "cde", "fg", "hijk", "lm", "ก" * 5, "straße", "STRASSE", "x"]
    return [(i, "ab"[i % 2], " ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randint(0, 12)))) for i in range(count)]


def tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, owner string, text string")
    terms = spark.createDataFrame(
        [("a", 0, "ab cde"), ("a", 1, "hijk zz"), ("a", 2, "??"), ("b", 0, "strasse กกกก"), ("b", 1, "ab"), ("b", 2, "ab")],
        "owner string, term_no int, term string",
    )
    return docs, terms


def same(got, want):
    columns = ["owner", "doc_id", "score", "matched", "place"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_ranking_equals_the_one_over_texts(spark, tmp_path):
    docs, terms = tables(spark, corpus())
    store = PostingStore(spark, str(tmp_path), ["owner"], shards=4).create()
    store.add(docs.where("doc_id % 5 > 0"), 0)
    store.add(docs.where("doc_id % 5 = 0"), 1)
    want = rt.retrieve(terms, docs, ["owner"])
    same(store.retrieve(terms), want)
    # A batch loaded twice is there once.
    store.add(docs.where("doc_id % 5 = 0"), 1)
    same(store.retrieve(terms), want)
    same(PostingStore(spark, str(tmp_path), ["owner"], shards=4).retrieve(terms), want)


def test_removed_documents_count_no_more(spark, tmp_path):
    docs, terms = tables(spark, corpus())
    store = PostingStore(spark, str(tmp_path / "old"), ["owner"], shards=4).create()
    store.add(docs, 0)
    gone = docs.where("doc_id % 3 = 0").select("doc_id")
    store.remove(gone, 1)
    want = rt.retrieve(terms, docs.where("doc_id % 3 > 0"), ["owner"])
    same(store.retrieve(terms), want)
    same(store.compact(str(tmp_path / "new")).retrieve(terms), want)


def test_requests_read_no_text_and_only_their_folders(spark, tmp_path):
    docs, terms = tables(spark, corpus())
    store = PostingStore(spark, str(tmp_path), ["owner"], shards=64).create()
    store.add(docs, 0)
    wanted = spark.createDataFrame([("a", "hijk")], "owner string, token string")
    hits, counts = store.asked(wanted)
    for asked in (hits, counts):
        plan = asked._jdf.queryExecution().toString()
        assert "text#" not in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Postings are joined where they lie: no exchange by token.
    assert "Exchange hashpartitioning(owner" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in counts.collect()} == {("a", "hijk", hits.count())}
    (number,) = wanted.select(_shard(64)).first()
    assert f" = {number})" in hits._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_a_request_without_tokens_and_an_empty_store(spark, tmp_path):
    docs, terms = tables(spark, corpus(6))
    store = PostingStore(spark, str(tmp_path), ["owner"]).create()
    assert store.retrieve(terms).collect() == []
    store.add(docs, 0)
    none = terms.where("term = '??'")
    assert {(r.doc_id, r.score, tuple(r.matched)) for r in store.retrieve(none).collect()} == {(i, 0.0, ()) for i in range(6)}


def test_terms_of_one_request_are_numbered_in_order(spark):
    terms = spark.createDataFrame([(n, "ab " * (n % 5)) for n in range(200)], "term_no int, term string").repartition(7)
    rows = sorted((r.term_at, r.term) for r in rt.term_tokens(terms).collect())
    assert rows == list(enumerate("ab " * (n % 5) for n in range(200) if n % 5))
