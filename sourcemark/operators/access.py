"""Who may see and publish what, and the lists each role works from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who may take a posting from which status to which. Only an admin publishes.
PUBLICATION_MOVES = (
    ("draft", "admin", "published"),
    ("draft", "admin", "closed"),
    ("draft", "owner", "closed"),
    ("published", "admin", "draft"),
    ("published", "admin", "closed"),
    ("published", "owner", "draft"),
    ("published", "owner", "closed"),
    ("closed", "admin", "draft"),
    ("closed", "admin", "published"),
    ("closed", "owner", "draft"),
)
# The order a recruiter reads the pipeline in.
PIPELINE_ORDER = ("screened", "shortlisted", "applied", "screening", "rejected", "withdrawn")


def is_public(status: Column) -> Column:
    return status == "published"


def publisher(role: Column, is_owner: Column) -> Column:
    """admin before owner (the wider right), null for anybody else."""
    return F.when(role == "admin", "admin").when(is_owner, "owner")


def plan_publication(requests: DataFrame, now: Column) -> DataFrame:
    """Judge (status, target, publisher, published_at): adds outcome, status_after, published_at_after.

    Asking for the status a posting already has is granted and changes nothing;
    ``published_at`` is stamped by the first publication only.
    """
    moves = ["|".join(move) for move in PUBLICATION_MOVES]
    permitted = F.concat_ws("|", "status", "publisher", "target").isin(moves)
    outcome = (
        F.when(F.col("publisher").isNull(), "not_yours")
        .when(F.col("status") == F.col("target"), "unchanged")
        .when(permitted, "moved")
        .when((F.col("target") == "published") & (F.col("publisher") == "owner"), "only_admin_publishes")
        .otherwise("no_such_move")
    )
    granted = F.col("outcome").isin("moved", "unchanged")
    stamped = granted & (F.col("target") == "published") & F.col("published_at").isNull()
    return (
        requests.withColumn("outcome", outcome)
        .withColumn("status_after", F.when(granted, F.col("target")).otherwise(F.col("status")))
        .withColumn("published_at_after", F.when(stamped, now).otherwise(F.col("published_at")))
    )


def backfill_roles(accounts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whoever already owns a job becomes a recruiter."""
    owners = jobs.select(F.col("owner_id").alias("account_id")).distinct().withColumn("_owns", F.lit(True))
    return (
        accounts.join(owners, "account_id", "left")
        .withColumn("role", F.when(F.col("_owns"), "recruiter").otherwise(F.col("role")))
        .drop("_owns")
    )


def backfill_publication(jobs: DataFrame) -> DataFrame:
    """Postings older than the lifecycle were public from the day they were written."""
    return jobs.withColumn("status", F.lit("published")).withColumn("published_at", F.col("created_at"))


def visible_resumes(
    resumes: DataFrame, applications: DataFrame, jobs: DataFrame, viewers: DataFrame, acting: bool = False
) -> DataFrame:
    """(viewer_id, resume_id, because) each viewer may read; ``acting`` needs more than reading.

    ``viewers``: viewer_id, role. Admins may do both everywhere and are answered with one row
    of ``because = 'admin'`` and no resume id instead of the whole table times the admins.
    """
    people = viewers.where(F.col("role") != "admin")
    own = resumes.join(people, resumes["owner_id"] == people["viewer_id"]).select(
        "viewer_id", "resume_id", F.lit("own").alias("because")
    )
    everything = viewers.where(F.col("role") == "admin").select(
        "viewer_id", F.lit(None).cast(resumes.schema["resume_id"].dataType).alias("resume_id"), F.lit("admin").alias("because")
    )
    if acting:
        return own.unionByName(everything)
    posted = jobs.join(people, jobs["owner_id"] == people["viewer_id"]).select("job_id", "viewer_id")
    applied = (
        applications.join(posted, "job_id")
        .join(resumes.select("resume_id", "owner_id"), "resume_id")
        .where(F.col("owner_id") != F.col("viewer_id"))
        .select("viewer_id", "resume_id")
        .distinct()
        .withColumn("because", F.lit("applied_to_mine"))
    )
    return own.unionByName(applied).unionByName(everything)


def may_screen(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, applications: DataFrame) -> DataFrame:
    """(job_id, resume_id) with ``allowed``: the owner's own resume, or one applied to this job."""
    applied = applications.select("job_id", "resume_id").distinct().withColumn("_applied", F.lit(True))
    return (
        pairs.join(jobs.select("job_id", F.col("owner_id").alias("_recruiter")), "job_id")
        .join(resumes.select("resume_id", F.col("owner_id").alias("_person")), "resume_id")
        .join(applied, ["job_id", "resume_id"], "left")
        .withColumn(
            "allowed",
            (F.col("_recruiter") == F.col("_person")) | F.coalesce(F.col("_applied"), F.lit(False)),
        )
        .drop("_recruiter", "_person", "_applied")
    )


def board(jobs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Published postings, newest first, as applicants see them: no weights, ids or status."""
    asked = requirements.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "kind", "label", "detail", "must_have"))),
            lambda r: F.struct(*[r[f].alias(f) for f in ("kind", "label", "detail", "must_have")]),
        ).alias("requirements"),
        F.count_if("must_have").alias("must_haves"),
    )
    none = F.array().cast("array<struct<kind:string,label:string,detail:string,must_have:boolean>>")
    return (
        jobs.where(is_public(F.col("status")))
        .join(asked, "job_id", "left")
        .orderBy(F.col("published_at").desc(), F.col("created_at").desc(), "job_id")
        .select(
            "job_id",
            "title",
            "description",
            "location",
            "published_at",
            F.coalesce(F.col("requirements"), none).alias("requirements"),
            F.coalesce(F.col("must_haves"), F.lit(0)).alias("must_haves"),
        )
    )


def list_jobs(jobs: DataFrame, viewer: Column | str, role: str) -> DataFrame:
    """A candidate's discovery list or an author's own postings, newest first."""
    mine = is_public(F.col("status")) if role == "candidate" else F.col("owner_id") == F.lit(viewer)
    return jobs.where(mine).orderBy(F.col("created_at").desc(), "job_id")


def readable_jobs(jobs: DataFrame, viewer: Column | str, role: str) -> DataFrame:
    """Postings an account may open: public ones, and unpublished ones of its own or of anyone for admins."""
    wider = (F.col("owner_id") == F.lit(viewer)) | F.lit(role == "admin")
    return jobs.where(is_public(F.col("status")) | wider)


def newest_first(rows: DataFrame, column: str, value, tie: str) -> DataFrame:
    """One owner's (or one job's) rows, newest first."""
    return rows.where(F.col(column) == value).orderBy(F.col("created_at").desc(), tie)


def applications_of_jobs(applications: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Everyone who applied to the given postings, newest first."""
    return (
        applications.join(jobs.select("job_id", "title"), "job_id")
        .join(resumes.select("resume_id", "filename"), "resume_id")
        .orderBy("job_id", F.col("created_at").desc(), "application_id")
    )


def applications_of_people(applications: DataFrame, resumes: DataFrame, jobs: DataFrame, people: DataFrame) -> DataFrame:
    """Everything the given people applied for, newest first."""
    return (
        applications.join(people, "candidate_id", "left_semi")
        .join(jobs.select("job_id", "title"), "job_id")
        .join(resumes.select("resume_id", "filename"), "resume_id")
        .orderBy("candidate_id", F.col("created_at").desc(), "application_id")
    )


def events_in_order(events: DataFrame, applications: DataFrame) -> DataFrame:
    """The log of the given applications, oldest entry first."""
    return events.join(applications.select("application_id"), "application_id", "left_semi").orderBy(
        "application_id", "position"
    )


def pipeline_counts(applications: DataFrame, by: list[str]) -> DataFrame:
    """Applications per state in reading order; states without any are left out."""
    order = F.array_position(F.array(*[F.lit(s) for s in PIPELINE_ORDER]), F.col("state"))
    return (
        applications.groupBy(*by, "state")
        .agg(F.count(F.lit(1)).alias("applications"))
        .withColumn("stage", order.cast("int"))
        .where(F.col("stage") > 0)
        .orderBy(*by, "stage")
    )


def open_to(jobs: DataFrame, applications: DataFrame, viewer) -> DataFrame:
    """Published postings one person has not applied to yet."""
    mine = applications.where(F.col("candidate_id") == viewer).select("job_id")
    return jobs.where(is_public(F.col("status"))).join(mine, "job_id", "left_anti")


def ready_resumes(resumes: DataFrame) -> DataFrame:
    """Resumes that can be put forward: extraction finished."""
    return resumes.where(F.col("status") == "extracted")
