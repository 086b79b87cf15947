"""Everything held about an account, and everything that goes when it is erased."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators.joins import small_side


def _section(df: DataFrame, name: str, at: Column, key: Column, item: Column) -> DataFrame:
    return df.select(
        F.col("account_id"),
        F.lit(name).alias("section"),
        at.cast("timestamp").alias("at"),
        key.cast("string").alias("item_id"),
        F.to_json(item, {"ignoreNullFields": "false"}).alias("item"),
    )


def export_accounts(tables: dict[str, DataFrame], accounts: DataFrame) -> DataFrame:
    """(account_id, section, at, item_id, item JSON) for the accounts asked for.

    One row per item rather than one giant document: an account may hold any share of the
    data, and a sink partitioned by account and sorted by (section, at, item_id) is the same
    document. A requirement list (at most 30) nests in its job; events are their own rows.
    """
    c = F.col
    asked = accounts.select("account_id")
    people = tables["accounts"].join(asked, "account_id", "left_semi")
    resumes = tables["resumes"].join(
        asked.withColumnRenamed("account_id", "owner_id"), "owner_id", "left_semi"
    ).withColumn("account_id", c("owner_id"))
    profiles = tables["profiles"].select("resume_id", "profile")
    jobs = tables["jobs"].join(
        asked.withColumnRenamed("account_id", "owner_id"), "owner_id", "left_semi"
    ).withColumn("account_id", c("owner_id"))
    wanted = tables["requirements"].join(jobs.select("job_id"), "job_id", "left_semi")
    requirements = wanted.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "kind", "label", "detail", "must_have", "weight"))),
            lambda r: F.struct(*[r[f].alias(f) for f in ("kind", "label", "detail", "must_have", "weight")]),
        ).alias("requirements")
    )
    applications = tables["applications"].join(
        asked.withColumnRenamed("account_id", "candidate_id"), "candidate_id", "left_semi"
    ).withColumn("account_id", c("candidate_id"))
    owned = resumes.select("resume_id", "account_id")
    screenings = tables["screenings"].join(owned, "resume_id")
    calls = tables["calls"].where(c("resume_id").isNotNull()).join(owned, "resume_id")
    events = tables["events"].join(applications.select("application_id", "account_id"), "application_id")

    branches = [
        _section(
            people,
            "account",
            c("created_at"),
            c("account_id"),
            F.struct(c("account_id").alias("id"), "email", "display_name", "role", "created_at"),
        ),
        _section(
            resumes.join(profiles, "resume_id", "left"),
            "resumes",
            c("created_at"),
            c("resume_id"),
            F.struct(
                c("resume_id").alias("id"),
                "filename",
                "size_bytes",
                "content_hash",
                "status",
                c("created_at").alias("uploaded_at"),
                "consented_at",
                "consent_version",
                "page_count",
                "pages_from_ocr",
                c("text").alias("document_text"),
                "profile",
            ),
        ),
        _section(
            jobs.join(requirements, "job_id", "left"),
            "jobs",
            c("created_at"),
            c("job_id"),
            F.struct(c("job_id").alias("id"), "title", "description", "created_at", "requirements"),
        ),
        _section(
            applications,
            "applications",
            c("created_at"),
            c("application_id"),
            F.struct(c("application_id").alias("id"), "job_id", "resume_id", "state", "created_at"),
        ),
        _section(
            events,
            "application_events",
            c("created_at"),
            F.concat_ws("#", c("application_id").cast("string"), F.lpad(c("position").cast("string"), 10, "0")),
            F.struct(
                "application_id",
                "position",
                "from_state",
                "to_state",
                F.coalesce(c("actor_id") == c("account_id"), F.lit(False)).alias("by_you"),
                c("actor_id").isNull().alias("by_the_system"),
                "reason",
                c("created_at").alias("at"),
            ),
        ),
        _section(
            screenings,
            "screenings",
            c("created_at"),
            c("screening_id"),
            F.struct(
                c("screening_id").alias("id"), "job_id", "resume_id", "status", "requirements_met", "requirements_total", "created_at"
            ),
        ),
        _section(
            calls,
            "model_calls",
            c("created_at"),
            c("call_id"),
            F.struct("provider", "model", "prompt_version", "input_tokens", "output_tokens", "cost_usd", c("created_at").alias("at")),
        ),
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


# Foreign keys that delete their row with the parent (child, key, parent) …
CASCADE = (
    ("resumes", "owner_id", "accounts"),
    ("jobs", "owner_id", "accounts"),
    ("tokens", "account_id", "accounts"),
    ("profiles", "resume_id", "resumes"),
    ("requirements", "job_id", "jobs"),
    ("screenings", "job_id", "jobs"),
    ("screenings", "resume_id", "resumes"),
    ("applications", "job_id", "jobs"),
    ("applications", "candidate_id", "accounts"),
    ("applications", "resume_id", "resumes"),
    ("calls", "resume_id", "resumes"),
    ("calls", "screening_id", "screenings"),
    ("events", "application_id", "applications"),
)
# … and those that only forget it.
SET_NULL = (("events", "actor_id", "accounts"), ("events", "screening_id", "screenings"))
KEY_OF = {
    "accounts": "account_id",
    "resumes": "resume_id",
    "jobs": "job_id",
    "screenings": "screening_id",
    "applications": "application_id",
}


def erase_accounts(tables: dict[str, DataFrame], accounts: DataFrame) -> dict[str, DataFrame]:
    """Surviving rows of every table, plus ``storage_keys``: the stored files to delete first.

    Doomed keys travel down the foreign keys, so each table is filtered by anti joins on the
    keys that were erased above it, in one reading of the table.
    """
    doomed = {"accounts": small_side(accounts.select("account_id").distinct())}
    survivors = {"accounts": tables["accounts"].join(doomed["accounts"], "account_id", "left_anti")}
    for child in dict.fromkeys(edge[0] for edge in CASCADE):
        if child not in tables:
            continue
        edges = [(key, parent) for name, key, parent in CASCADE if name == child and parent in doomed]
        if child in KEY_OF:
            gone = [
                tables[child]
                .join(doomed[parent].withColumnRenamed(KEY_OF[parent], key), key, "left_semi")
                .select(KEY_OF[child])
                for key, parent in edges
            ]
            keys = gone[0]
            for more in gone[1:]:
                keys = keys.unionByName(more)
            # Written once: every table below reads these few keys.
            doomed[child] = small_side(keys.distinct())
        rest = tables[child]
        for key, parent in edges:
            rest = _dealt(rest, key).join(_erased(doomed[parent], KEY_OF[parent], key), [key, _SALT], "left_anti").drop(_SALT)
        survivors[child] = rest.select(*tables[child].columns)
    for child, key, parent in SET_NULL:
        if child in survivors and parent in doomed:
            survivors[child] = _forget(survivors[child], key, doomed[parent], KEY_OF[parent])
    survivors["storage_keys"] = tables["resumes"].join(
        doomed["accounts"].withColumnRenamed("account_id", "owner_id"), "owner_id", "left_semi"
    ).select("owner_id", "storage_key")
    return survivors


_SALT = "_salt"
# Tasks over which rows without a key are dealt.
NULL_SALTS = 1_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that name nobody match nothing; a salt keeps them from meeting in one task."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(NULL_SALTS)).cast("int")
    return rows.withColumn(_SALT, F.when(F.col(key).isNull(), salt).otherwise(-1))


def _erased(keys: DataFrame, name: str, key: str) -> DataFrame:
    return keys.select(F.col(name).alias(key), F.lit(-1).alias(_SALT))


def _forget(rows: DataFrame, key: str, erased: DataFrame, erased_key: str) -> DataFrame:
    marked = _erased(erased, erased_key, key).withColumn("_erased", F.lit(True))
    named = _dealt(rows, key).join(marked, [key, _SALT], "left")
    return named.withColumn(key, F.when(F.col("_erased").isNull(), F.col(key))).select(*rows.columns)
