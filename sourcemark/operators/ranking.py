"""Order judged screenings by what their citations prove, and report those left out.

Weights and must-haves come from the job as it is now, matched by position: ids may have
changed, the fingerprint guarantees that positions have not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.functions.numbers import round_exact
from sourcemark.operators.joins import small_side
from sourcemark.operators.judging import MET, SPEC, is_stale
from sourcemark.operators.ordered import number_within
from sourcemark.session import settle

# Why a screening takes no part.
EXCLUSIONS = ("not_completed", "stale", "malformed")

# Jobs a broadcast may hold: with thirty requirements each, some ten megabytes.
SMALL_JOBS = 3_000


def _specs() -> Column:
    return F.coalesce(F.col("specs"), F.array().cast(f"array<{SPEC}>"))


def classify(screenings: DataFrame, jobs: DataFrame, prompt: str) -> DataFrame:
    """Add ``reason`` as far as the screening alone tells it (null = its verdicts decide).

    ``jobs``: job_id, specs, current_hash. ``_asked`` is the number of verdicts the job asks for.
    """
    asked = jobs.select("job_id", "current_hash", F.size(_specs()).alias("_asked"))
    joined = screenings.join(asked, "job_id", "left")
    stale = is_stale(
        F.col("requirements_hash"), F.col("prompt_version"), F.col("current_hash"), F.lit(prompt)
    )
    reason = F.when(~F.col("status").eqNullSafe(F.lit("completed")), EXCLUSIONS[0]).when(stale, EXCLUSIONS[1])
    return joined.withColumn("_asked", F.coalesce("_asked", F.lit(0))).withColumn("reason", reason).drop("current_hash")


def collect_verdicts(screenings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """screening_id, ``requirements``: its rows of ``verdicts`` nested, ``_held``: how many.

    Rows of other screenings are left out before anything is nested. The ids that select them are
    narrow, so they are hashed and the verdicts need no sort.
    """
    own = screenings.select("screening_id").hint("shuffle_hash")
    columns = [c for c in verdicts.columns if c != "screening_id"]
    return (
        verdicts.join(own, "screening_id", "left_semi")
        .groupBy("screening_id")
        .agg(F.collect_list(F.struct(*columns)).alias("requirements"), F.count(F.lit(1)).alias("_held"))
    )


def rekey(judged: Column, specs: Column) -> Column:
    """Stored verdicts under the current requirements, position by position."""
    return F.zip_with(
        specs,
        judged,
        lambda spec, item: F.struct(
            spec["id"].alias("requirement_id"),
            spec["label"].alias("label"),
            spec["must_have"].alias("must_have"),
            spec["weight"].alias("weight"),
            item["verdict"].alias("verdict"),
            item["evidence"].alias("evidence"),
        ),
    )


def _total_weight(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["weight"])


def score(complete: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts, gate and weighted score of the rankable rows; sums run in position order."""
    rows = complete.join(jobs.select("job_id", "specs"), "job_id", "left").withColumn(
        "requirements", rekey(F.col("requirements"), _specs())
    )
    items = F.col("requirements")
    met = F.filter(items, lambda r: r["verdict"] == MET)
    must = F.filter(items, lambda r: r["must_have"])
    must_met = F.filter(items, lambda r: r["must_have"] & (r["verdict"] == MET))
    total = _total_weight(items)
    return (
        rows.withColumn("must_haves_met", F.size(must_met))
        .withColumn("must_haves_total", F.size(must))
        .withColumn("requirements_met", F.size(met))
        .withColumn("requirements_total", F.size(items))
        .withColumn("gate_passed", F.col("must_haves_met") == F.col("must_haves_total"))
        .withColumn(
            "score",
            F.when(total > 0, round_exact(_total_weight(met) / total, 6)).otherwise(F.lit(0.0)),
        )
        .drop("specs")
    )


def rank(scored: DataFrame) -> DataFrame:
    """1-based rank per job: gate, score, requirements met, then id. Jobs may be of any size.

    Only the columns that decide are sorted; verdicts and citations join their rank by screening.
    Both come from one written copy, or the verdicts would be collected anew for each.
    """
    scored = settle(scored)
    order = [
        F.col("gate_passed").desc(),
        F.col("score").desc(),
        F.col("requirements_met").desc(),
        F.col("screening_id").asc(),
    ]
    deciding = scored.select("job_id", "gate_passed", "score", "requirements_met", "screening_id")
    numbered = number_within(deciding, ["job_id"], order, "rank").select("screening_id", "rank")
    return scored.join(numbered, "screening_id")


def rationale(ranked: DataFrame) -> DataFrame:
    """Why each ranked screening stands where it does: a row per requirement, with its verdict and citations."""
    return ranked.select(
        "job_id", "rank", "screening_id", "filename", F.posexplode("requirements").alias("position", "_r")
    ).select("job_id", "rank", "screening_id", "filename", "position", "_r.*")


def _sorted_out(
    screenings: DataFrame, jobs: DataFrame, resumes: DataFrame, prompt: str, verdicts: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(screenings left out for what they are, current ones with their verdicts), with the filename."""
    classified = classify(screenings, jobs, prompt)
    current = classified.where(F.col("reason").isNull())
    filenames = resumes.select("resume_id", "filename")
    early = classified.where(F.col("reason").isNotNull()).join(filenames, "resume_id")
    named = current.join(filenames, "resume_id")
    if verdicts is None:
        held = F.when(F.col("requirements").isNotNull(), F.size("requirements"))
        return early, named.withColumn("_held", held)
    return early, named.join(collect_verdicts(current, verdicts), "screening_id", "left")


def _malformed() -> Column:
    return F.coalesce(F.col("_held") != F.col("_asked"), F.lit(True))


def ranked(
    screenings: DataFrame,
    jobs: DataFrame,
    resumes: DataFrame,
    prompt: str,
    verdicts: DataFrame | None = None,
    judged: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rankable screenings with rank, verdicts, citations and the filename.

    Verdicts are the screenings' ``requirements``, or rows of a table of their own: ``verdicts``
    holds screening_id and columns in whose order they stand, ``judged`` makes of such a row its
    verdict and evidence. Rows are collected for current screenings, judged for complete ones.
    """
    jobs = small_side(jobs, SMALL_JOBS)
    _, current = _sorted_out(screenings, jobs, resumes, prompt, verdicts)
    told = F.col("requirements") if judged is None else F.transform(F.array_sort("requirements"), judged)
    complete = current.where(~_malformed()).withColumn("requirements", told)
    return rank(score(complete.drop("reason", "_held", "_asked"), jobs))


def excluded(
    screenings: DataFrame, jobs: DataFrame, resumes: DataFrame, prompt: str, verdicts: DataFrame | None = None
) -> DataFrame:
    """Screenings that take no part, with the reason and the filename. Verdicts are counted, not read."""
    columns = ["job_id", "screening_id", "resume_id", "filename", "status", "reason"]
    early, current = _sorted_out(screenings, small_side(jobs, SMALL_JOBS), resumes, prompt, verdicts)
    late = current.where(_malformed()).withColumn("reason", F.lit(EXCLUSIONS[2]))
    return early.select(columns).unionByName(late.select(columns))


def ranking_report(
    screenings: DataFrame, jobs: DataFrame, resumes: DataFrame, prompt: str
) -> tuple[DataFrame, DataFrame]:
    """(ranked with verdicts and citations, excluded with the reason), both with the filename.

    A screening of a resume that no longer exists is in neither, as cascading deletes imply.
    """
    return ranked(screenings, jobs, resumes, prompt), excluded(screenings, jobs, resumes, prompt)
