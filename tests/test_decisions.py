"""Judging, ranking, retrieval and usage on small cases with known answers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sourcemark.operators import judging as jd
from sourcemark.operators import ranking as rk
from sourcemark.operators import retrieval as rt
from sourcemark.operators import usage as us

TEXT = "Python and SQL since 2019.\nLed the platform team.\nWrote Go services."
REQUIREMENT = "job_id int, position int, created_at int, id string, label string, kind string, detail string, must_have boolean, weight double"
RAW = "job_id int, doc_id int, matches array<struct<requirement:int,quotes:array<string>>>"


def specs(spark, labels, job=1):
    rows = [(job, i, 0, f"r-{l}", l, "skill", None, m, float(w)) for i, (l, m, w) in enumerate(labels)]
    return jd.requirement_specs(spark.createDataFrame(rows, REQUIREMENT))


def judge(spark, matches, labels=(("Python", False, 1), ("Go", False, 1))):
    raw = spark.createDataFrame([(1, 7, matches)], RAW)
    docs = spark.createDataFrame([(7, TEXT)], "doc_id int, text string")
    (row,) = jd.judge(raw, specs(spark, labels), docs, ["job_id", "doc_id"]).collect()
    return row


def test_numbers_nobody_asked_for_are_dropped(spark):
    row = judge(spark, [(0, ["Python and SQL"]), (3, ["Python and SQL", "again"]), (1, ["Python and SQL"])])
    assert [r.verdict for r in row.requirements] == ["met", "not_evidenced"]
    assert [(d.field, d.value, d.reason) for d in row.dropped] == [
        ("matches[requirement=0]", "requirement 0", "unknown_requirement"),
        ("matches[requirement=3]", "requirement 3", "unknown_requirement"),
        ("matches[requirement=3]", "requirement 3", "unknown_requirement"),
    ]
    assert row.hallucination_rate == 0.75


def test_repeated_numbers_merge_in_order(spark):
    row = judge(spark, [(1, ["Python and SQL"]), (2, ["Wrote Go services."]), (1, ["since 2019"])])
    assert [e.quote for e in row.requirements[0].evidence] == ["Python and SQL", "since 2019"]
    assert row.requirements_met == 2 and row.dropped == []


def test_an_invented_quote_meets_nothing(spark):
    row = judge(spark, [(1, ["Ten years of Python at Google"])])
    assert row.requirements_met == 0 and row.dropped[0].reason == "not_found"


def test_no_requirements_give_an_empty_judgment(spark):
    raw = spark.createDataFrame([(9, 7, [(1, ["Python and SQL"])])], RAW)
    docs = spark.createDataFrame([(7, TEXT)], "doc_id int, text string")
    (row,) = jd.judge(raw, specs(spark, [("x", False, 1)]), docs, ["job_id", "doc_id"]).collect()
    assert row.requirements == [] and row.requirements_total == 0
    assert row.dropped[0].reason == "unknown_requirement"


def test_fingerprint_is_the_hash_of_the_compact_list(spark):
    rows = [(1, 1, 0, "a", 'say "ทักษะ" / ü', "skill", "d", True, 2.0), (1, 0, 0, "b", "x", "other", None, False, 1.0)]
    df = jd.requirement_specs(spark.createDataFrame(rows, REQUIREMENT))
    (row,) = df.select(jd.fingerprint(F.col("specs")).alias("f")).collect()
    want = json.dumps([["other", "x", ""], ["skill", 'say "ทักษะ" / ü', "d"]], ensure_ascii=False, separators=(",", ":"))
    assert row.f == hashlib.sha256(want.encode()).hexdigest()


SCREENING = (
    "screening_id string, resume_id string, job_id int, status string, requirements_hash string, prompt_version string, "
    "requirements array<struct<verdict:string,evidence:array<string>>>"
)


def ranked(spark, labels, people, **overrides):
    rows = []
    for name, met in people.items():
        verdicts = [("met" if label in met else "not_evidenced", []) for label, _, _ in labels]
        base = dict(status="completed", requirements_hash="h", prompt_version="v", requirements=verdicts)
        base.update(overrides.get(name, {}))
        rows.append((name, "cv-" + name, 1, base["status"], base["requirements_hash"], base["prompt_version"], base["requirements"]))
    jobs = specs(spark, labels).withColumn("current_hash", F.lit("h")) if labels else spark.createDataFrame(
        [(1, [], "h")], f"job_id int, specs array<{jd.SPEC}>, current_hash string"
    )
    resumes = spark.createDataFrame([("cv-" + n, n + ".pdf") for n in people], "resume_id string, filename string")
    good, bad = rk.ranking_report(spark.createDataFrame(rows, SCREENING), jobs, resumes, "v")
    return sorted(good.collect(), key=lambda r: r.rank), {r.screening_id: r.reason for r in bad.collect()}


def test_the_gate_comes_before_the_score(spark):
    labels = [("Python", True, 1), ("SQL", False, 1), ("Go", False, 5), ("AWS", False, 5)]
    good, _ = ranked(spark, labels, {"a": {"Python", "SQL"}, "b": {"SQL", "Go", "AWS"}})
    assert [(r.screening_id, r.rank, r.gate_passed) for r in good] == [("a", 1, True), ("b", 2, False)]
    assert good[1].score > good[0].score


def test_partial_must_haves_and_ties(spark):
    labels = [("Python", True, 1), ("SQL", True, 1), ("Go", True, 1)]
    good, _ = ranked(spark, labels, {"b-none": set(), "a-none": set(), "two": {"Python", "SQL"}})
    assert [r.screening_id for r in good] == ["two", "a-none", "b-none"]
    assert not any(r.gate_passed for r in good)


def test_weights_and_empty_jobs(spark):
    good, _ = ranked(spark, [("Python", False, 9), ("SQL", False, 1)], {"heavy": {"Python"}, "light": {"SQL"}})
    assert [(r.screening_id, r.score) for r in good] == [("heavy", 0.9), ("light", 0.1)]
    good, _ = ranked(spark, [], {"a": set()})
    assert (good[0].score, good[0].gate_passed, good[0].requirements_total) == (0.0, True, 0)


def test_exclusions_are_reported(spark):
    people = {n: {"Python"} for n in ("ok", "old", "prompt", "nohash", "busy", "null", "short")}
    good, bad = ranked(
        spark, [("Python", False, 1), ("SQL", False, 1)], people,
        old={"requirements_hash": "x"}, prompt={"prompt_version": "v0"}, nohash={"requirements_hash": None},
        busy={"status": "processing"}, null={"requirements": None}, short={"requirements": [("met", [])]},
    )
    assert [r.screening_id for r in good] == ["ok"]
    assert bad == {
        "old": "stale", "prompt": "stale", "nohash": "stale", "busy": "not_completed", "null": "malformed", "short": "malformed",
    }


def retrieve(spark, terms, docs):
    t = spark.createDataFrame(list(enumerate(terms)), "term_no int, term string")
    d = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    return sorted(rt.retrieve(t, d).collect(), key=lambda r: r.place)


def test_retrieval_orders_and_keeps_everything(spark):
    rows = retrieve(spark, ["Kubernetes"], {"a": "Python and PostgreSQL", "b": "Kubernetes and Terraform"})
    assert [(r.doc_id, r.matched) for r in rows] == [("b", ["Kubernetes"]), ("a", [])]
    assert rows[1].score == 0.0
    rows = retrieve(spark, ["Python", "Kubernetes"], {"a": "Python", "b": "Python Kubernetes"})
    assert [r.doc_id for r in rows] == ["b", "a"]
    assert [r.doc_id for r in retrieve(spark, ["zzz"], {"c": "x", "a": "y", "b": "z"})] == ["a", "b", "c"]


def test_retrieval_scores_match_the_definition(spark):
    import math

    docs = {"a": "go rust go python", "b": "rust java", "c": "ชำระเงินด้วย Python"}
    terms = ["Python rust", "java", "Python rust", "ชำระเงิน", "a", ""]
    rows = {r.doc_id: r for r in retrieve(spark, terms, docs)}
    df = {"python": 2, "rust": 2, "java": 1}
    idf = {k: math.log(1 + 3 / (1 + v)) for k, v in df.items()}
    assert rows["a"].score == pytest.approx(2 * (idf["python"] + idf["rust"]) / 2)
    assert rows["b"].score == pytest.approx(2 * 0.5 * idf["rust"] + idf["java"])
    assert rows["c"].score == pytest.approx(2 * 0.5 * idf["python"] + math.log(1 + 3 / 2))
    assert rows["b"].matched == ["Python rust", "java", "Python rust"]


CALL = "resume_id int, screening_id int, provider string, model string, prompt_version string, input_tokens int, output_tokens int, cached_input_tokens int, latency_ms int, cost_usd double"


def calls(spark, rows):
    return spark.createDataFrame([(r, s, "p", "m", v, 10, 1, 0, 100, c) for r, s, v, c in rows], CALL)


def levels(report):
    return {(r.level, r.bucket): r for r in report.collect() if r.level != "group"}


def test_a_partial_cost_is_no_cost(spark):
    full = levels(us.usage_report(calls(spark, [(1, None, "e", 0.25), (2, None, "e", 0.75)])))
    assert (full[("total", None)].calls_priced, full[("total", None)].cost_usd) == (2, 1.0)
    part = levels(us.usage_report(calls(spark, [(1, None, "e", 0.5), (None, 4, "j", None)])))
    assert part[("total", None)].cost_usd is None
    assert part[("bucket", "extraction")].cost_usd == 0.5
    assert part[("bucket", "unattributed")].cost_usd == 0.0


def test_an_empty_report_has_every_bucket(spark):
    rows = levels(us.usage_report(calls(spark, []) if False else calls(spark, [(1, None, "e", 0.1)]).where("false")))
    assert {k[1] for k in rows} == {*us.BUCKETS, None}
    assert all(r.calls == 0 and r.latency_ms_mean is None and r.cost_usd == 0.0 for r in rows.values())


def test_quality_comes_from_totals(spark):
    rows = spark.createDataFrame([(1, 1, 1), (98, 0, 3)], "claims_verified int, claims_dropped int, attempts int")
    (row,) = us.quality(rows).collect()
    assert (row.claims_verified, row.claims_dropped, row.hallucination_rate) == (99, 1, 0.01)
    (empty,) = us.quality(rows.where("false")).collect()
    assert empty.hallucination_rate is None and empty.profiles == 0


def test_documents_without_text_are_refused_not_judged(spark):
    docs = spark.createDataFrame([(1, "Python here"), (2, ""), (3, None)], "doc_id long, text string")
    raw = spark.createDataFrame(
        [(1, d, [(1, ["Python here"])]) for d in (1, 2, 3)],
        "job_id long, doc_id long, matches array<struct<requirement:int,quotes:array<string>>>",
    )
    got = {r.doc_id: r for r in jd.judge(raw, specs(spark, [("x", False, 1)]), docs, ["job_id", "doc_id"]).collect()}
    assert [got[d].refusal for d in (1, 2, 3)] == [None, "no_text", "no_text"]
    assert (len(got[1].requirements), got[2].requirements, got[3].requirements_total) == (1, [], 0)
