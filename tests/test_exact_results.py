"""Results that differ from their SQL only on large or nearly equal values."""

from pyspark.sql import functions as F

from sourcemark.operators import retrieval as rt
from sourcemark.operators import usage as us
from sourcemark.operators.postings import PostingStore
from sourcemark.plans import usage_report as ur


def test_thousands_are_set_apart_on_screens_only(spark, tmp_path):
    counts = spark.createDataFrame([(1234,), (1,), (0,)], "n bigint")
    notes = lambda **how: [r[0] for r in counts.select(us.dropped_note(F.col("n"), **how)).collect()]
    assert notes() == ["1,234 claims dropped", "1 claim dropped", None]
    assert notes(grouped=False) == ["1234 claims dropped", "1 claim dropped", None]
    rows = spark.range(1500)
    rows.select(F.col("id").alias("doc_id"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    rows.select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.note for r in ur.quality(spark, str(tmp_path)).collect()] == ["1500 claims dropped"]


# The second document has the rarer token: it scores a little more than the first.
NEARLY = {1: "common rust", 2: "common java", 3: "common", 4: "rust"}


def test_scores_that_agree_to_the_digits_asked_for_tie(spark):
    terms = spark.createDataFrame([(0, "rust"), (1, "java")], "term_no int, term string")
    docs = spark.createDataFrame(list(NEARLY.items()), "doc_id bigint, text string")
    order = lambda rows: [r.doc_id for r in sorted(rows.collect(), key=lambda r: r.place)]
    assert order(rt.retrieve(terms, docs)) == [2, 1, 4, 3]
    assert order(rt.retrieve(terms, docs, digits=6)) == [2, 1, 4, 3]
    assert order(rt.retrieve(terms, docs, digits=0)) == [1, 2, 4, 3]


def test_stored_scores_that_agree_tie_as_well(spark, tmp_path):
    terms = spark.createDataFrame([(0, "rust"), (1, "java")], "term_no int, term string")
    store = PostingStore(spark, f"{tmp_path}/store", shards=2).create()
    store.add(spark.createDataFrame(list(NEARLY.items()), "doc_id bigint, text string"), 0)
    order = lambda rows: [r.doc_id for r in sorted(rows.collect(), key=lambda r: r.place)]
    assert order(store.retrieve(terms, digits=6)) == [2, 1, 4, 3]
    assert order(store.retrieve(terms, digits=0)) == [1, 2, 4, 3]


def test_candidates_equal_but_for_noise_tie_by_id(spark):
    # Three thirds of a term count as much as a whole one; each owner has one more document beside the two.
    owners = [f"o{n}" for n in range(24)]
    resumes = spark.createDataFrame(
        [(o, 100 * i + d, text, f"{d}.pdf") for i, o in enumerate(owners) for d, text in [(1, "aa bb cc"), (2, "zz")] + [(3 + k, "none") for k in range(i)]],
        "owner_id string, resume_id bigint, text string, filename string",
    )
    requests = spark.createDataFrame([(1, o) for o in owners], "job_id bigint, owner_id string")
    requirements = spark.createDataFrame(
        [(1, 0, "aa bb cc", None), (1, 1, "zz", None)], "job_id bigint, position int, label string, detail string"
    )
    screenings = spark.createDataFrame([], "job_id bigint, resume_id bigint")
    places = {r.resume_id: r.place for r in rt.suggest_candidates(requests, requirements, resumes, screenings).collect()}
    assert [places[100 * i + 1] for i in range(24)] == [1] * 24
    assert [places[100 * i + 2] for i in range(24)] == [2] * 24
