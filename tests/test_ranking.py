"""Ranking reads the verdicts it needs, once."""

import datetime

import pytest
from pyspark.sql import functions as F

from sourcemark.operators import judging as jd
from sourcemark.operators import ranking as rk
from sourcemark.plans import screening as sc


@pytest.fixture
def orders_dir(spark, tmp_path):
    """A ranked order, a stale one, one under way and one with a line too few, of four lines each; the
    second and third hold a supplier too large for an offset."""
    tables = {
        "customer": ([(0, "c")], "c_custkey long, c_name string"),
        "orders": (
            [(1, 0, "F", "3-MEDIUM"), (2, 0, "F", "1-URGENT"), (3, 0, "P", "3-MEDIUM"), (4, 0, "F", "3-MEDIUM")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
        ),
        "lineitem": (
            [
                (order, 10 + n, 2**40 if order in (2, 3) else 7, n, 1.0, 2.0, datetime.datetime(2020, 1, 1), "A" if n < 3 else "N")
                for order in (1, 2, 3, 4)
                for n in range(1, 4 if order == 4 else 5)
            ],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_shipdate timestamp, l_returnflag string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_only_verdicts_of_ranked_orders_are_judged(spark, orders_dir):
    rows = sorted(sc.ranking_rationale(spark, orders_dir).collect(), key=lambda r: r.position)
    assert [(r.screening_id, r.rank, r.verdict, r.quote, r.char_start) for r in rows] == [
        (1, 1, "met", "part 11", 70), (1, 1, "met", "part 12", 70), (1, 1, "not_evidenced", None, None), (1, 1, "not_evidenced", None, None)
    ]
    reasons = {r.screening_id: r.reason for r in sc.excluded_orders(spark, orders_dir).collect()}
    assert reasons == {2: "stale", 3: "not_completed", 4: "malformed"}


@pytest.mark.parametrize("query", [sc.ranking_rationale, sc.rank_orders])
def test_verdicts_are_collected_once(spark, sf_dir, query):
    """They are written before they are ranked: what is left of the query collects none."""
    plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_the_report_of_the_excluded_only_counts_verdicts(spark, sf_dir):
    plan = sc.excluded_orders(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "count(1)" in plan


@pytest.mark.parametrize("small_jobs", [rk.SMALL_JOBS, 0])
def test_verdicts_in_a_table_rank_as_nested_ones(spark, monkeypatch, small_jobs):
    monkeypatch.setattr(rk, "SMALL_JOBS", small_jobs)
    spec = [("r1", "a", "skill", None, True, 3.0), ("r2", "b", "skill", None, False, 1.0)]
    jobs = spark.createDataFrame(
        [(1, spec, "h"), (2, [], "h"), (3, None, "h")], f"job_id int, specs array<{jd.SPEC}>, current_hash string"
    )
    # name, job, status, hash, verdicts in order
    given = [
        ("both", 1, "completed", "h", ["met", "met"]),
        ("first", 1, "completed", "h", ["met", "not_evidenced"]),
        ("second", 1, "completed", "h", ["not_evidenced", "met"]),
        ("tied", 1, "completed", "h", ["met", "not_evidenced"]),
        ("short", 1, "completed", "h", ["met"]),
        ("long", 1, "completed", "h", ["met"] * 3),
        ("none", 1, "completed", "h", None),
        ("unasked", 2, "completed", "h", ["met"]),
        ("null", 3, "completed", "h", ["met"]),
        ("stale", 1, "completed", "x", ["met", "met"]),
        ("nohash", 1, "completed", None, ["met", "met"]),
        ("nojob", 9, "completed", "h", ["met", "met"]),
        ("nostatus", 1, None, "h", ["met", "met"]),
        ("gone", 1, "completed", "h", ["met", "met"]),
    ]
    screenings = spark.createDataFrame(
        [(n, "cv-" + n, j, s, h, "v", r and [(v, ["quote " + v]) for v in r]) for n, j, s, h, r in given],
        "screening_id string, resume_id string, job_id int, status string, requirements_hash string, prompt_version string, "
        "requirements array<struct<verdict:string,evidence:array<string>>>",
    )
    resumes = spark.createDataFrame([("cv-" + n, n) for n, *_ in given if n != "gone"], "resume_id string, filename string")
    verdicts = screenings.select("screening_id", F.posexplode("requirements").alias("place", "told")).orderBy(F.desc("place"))
    nested = rk.ranking_report(screenings, jobs, resumes, "v")
    apart = (
        rk.ranked(screenings.drop("requirements"), jobs, resumes, "v", verdicts, lambda row: row["told"]),
        rk.excluded(screenings.drop("requirements"), jobs, resumes, "v", verdicts),
    )
    for one, other in zip(nested, apart):
        assert sorted(one.columns) == sorted(other.columns)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))
    assert [r.screening_id for r in sorted(nested[0].collect(), key=lambda r: r.rank)] == ["both", "first", "tied", "second"]
    assert {r.screening_id: r.reason for r in nested[1].collect()} == {
        **dict.fromkeys(("short", "long", "none", "unasked", "null"), "malformed"),
        **dict.fromkeys(("stale", "nohash", "nojob"), "stale"), "nostatus": "not_completed",
    }
