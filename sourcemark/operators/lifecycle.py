"""Applications as an append-only log: planning, applying and replaying moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.functions import text as tx
from sourcemark.operators.judging import fingerprint
from sourcemark.operators.ordered import number_within, previous_within

# States, the two that end an application, and who may move it where.
STATES = ("applied", "screening", "screened", "shortlisted", "rejected", "withdrawn")
TERMINAL = ("rejected", "withdrawn")
TRANSITIONS = (
    ("applied", "system", "screening"),
    ("applied", "job_owner", "rejected"),
    ("applied", "applicant", "withdrawn"),
    ("screening", "system", "screened"),
    ("screening", "system", "applied"),
    ("screening", "job_owner", "rejected"),
    ("screening", "applicant", "withdrawn"),
    ("screened", "system", "screening"),
    ("screened", "job_owner", "shortlisted"),
    ("screened", "job_owner", "rejected"),
    ("screened", "applicant", "withdrawn"),
    ("shortlisted", "system", "screening"),
    ("shortlisted", "job_owner", "rejected"),
    ("shortlisted", "applicant", "withdrawn"),
)
NEEDS_REASON = "rejected"
NEEDS_EVIDENCE = "shortlisted"
# What a screening's status asks of the application behind it.
FOLLOWED = {
    "pending": ("screening", "a screening was queued"),
    "processing": ("screening", "a screening was queued"),
    "completed": ("screened", "the screening completed"),
    "failed": ("applied", "the screening could not be produced"),
    "dead_lettered": ("applied", "the screening could not be produced"),
}
# Why a move is refused, as shown to the person asking (%1 = now, %2 = wanted, %3 = mover).
REFUSALS = {
    "terminal": "This application is %1$s and cannot be moved again.",
    "already_there": "This application is already %1$s.",
    "someone_else": "An application can be moved to %2$s by someone else, not by the %3$s.",
    "unscreened": "An application can only be shortlisted once it has been screened, so "
    "there is cited evidence behind the decision.",
    "no_such_move": "An application cannot go from %1$s to %2$s.",
    "needs_reason": "Moving an application to %2$s needs a reason.",
    "needs_evidence": "Moving an application to %2$s needs a completed screening to rest on.",
}
# Rows per block of the sequential fold; see states_before.
BLOCK = 128


def _listed(values: Sequence[str], *parts: Column) -> Column:
    return F.concat_ws("|", *parts).isin(*values)


def may_move(state: Column, mover: Column, to_state: Column) -> Column:
    return F.coalesce(_listed(["|".join(t) for t in TRANSITIONS], state, mover, to_state), F.lit(False))


def replay(events: DataFrame) -> DataFrame:
    """application_id → replayed_state; null where an event does not continue the last one."""
    linked = previous_within(
        events.select("application_id", "position", "from_state", "to_state"),
        ["application_id"],
        ["position"],
        ["to_state"],
        "_before",
    )
    return (
        linked.groupBy("application_id")
        .agg(
            F.bool_and(F.col("from_state").eqNullSafe(F.col("_before.to_state"))).alias("_sound"),
            F.max_by("to_state", "position").alias("_last"),
            F.count(F.lit(1)).alias("events"),
        )
        .select("application_id", F.when(F.col("_sound"), F.col("_last")).alias("replayed_state"), "events")
    )


def audit(applications: DataFrame, events: DataFrame) -> DataFrame:
    """Stored state against the state the log says; an application without events has none."""
    return (
        applications.select("application_id", "state")
        .join(replay(events), "application_id", "left")
        .withColumn("events", F.coalesce(F.col("events"), F.lit(0)))
        .withColumn("agrees", F.col("state").eqNullSafe(F.col("replayed_state")))
    )


def resolve_mover(role: Column, is_applicant: Column, is_job_owner: Column) -> Column:
    """job_owner for the owner and admins (the wider right), else applicant, else null."""
    return F.when(is_job_owner | (role == "admin"), "job_owner").when(is_applicant, "applicant")


def refusal_kind(state: Column, to_state: Column, mover: Column, reason: Column, screening_id: Column) -> Column:
    """The first rule a move breaks, a key of REFUSALS; null when it may be made."""
    said = tx.strip(F.coalesce(reason, F.lit(""))) != ""
    backed = F.coalesce(screening_id.cast("string"), F.lit("")) != ""
    reachable = _listed(sorted({f"{s}|{t}" for s, _, t in TRANSITIONS}), state, to_state)
    return (
        F.when(state.isin(*TERMINAL), "terminal")
        .when(state == to_state, "already_there")
        .when(
            ~may_move(state, mover, to_state),
            F.when(reachable, "someone_else").when(to_state == NEEDS_EVIDENCE, "unscreened").otherwise("no_such_move"),
        )
        .when((to_state == NEEDS_REASON) & ~said, "needs_reason")
        .when((to_state == NEEDS_EVIDENCE) & ~backed, "needs_evidence")
    )


def refusal_text(kind: Column, state: Column, to_state: Column, mover: Column) -> Column:
    """A refusal in words; null for a move that may be made."""
    words = F.lit(None).cast("string")
    for name, template in REFUSALS.items():
        words = F.when(kind == name, F.format_string(template, state, to_state, mover)).otherwise(words)
    return words


def plan_moves(requests: DataFrame, state: str = "state") -> DataFrame:
    """Judge one move per row against ``state``: adds allowed, why, and the trimmed reason."""
    kind = refusal_kind(*(F.col(c) for c in (state, "to_state", "mover", "reason", "screening_id")))
    said = tx.strip(F.coalesce(F.col("reason"), F.lit("")))
    return (
        requests.withColumn("_kind", kind)
        .withColumn("why", refusal_text(F.col("_kind"), *(F.col(c) for c in (state, "to_state", "mover"))))
        .withColumn("allowed", F.col("_kind").isNull())
        .withColumn("reason", F.when(said != "", said))
        .drop("_kind")
    )


def _effect() -> Column:
    """For each state the application may be in: the state after this request, and 0/1 moved."""
    effects = []
    for index, name in enumerate(STATES):
        state = F.lit(name)
        asked = (F.col(c) for c in ("to_state", "mover", "reason", "screening_id"))
        allowed = refusal_kind(state, *asked).isNull()
        to = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("to_state")).cast("int") - 1
        effects.append(
            F.struct(
                F.when(allowed, to).otherwise(index).alias("state"),
                F.when(allowed, 1).otherwise(0).cast("bigint").alias("moved"),
            )
        )
    return F.array(*effects)


def _then(first: Column, second: Column) -> Column:
    """The effect of two requests in a row."""
    return F.transform(
        first,
        lambda e: F.struct(
            F.get(second, e["state"])["state"].alias("state"),
            (e["moved"] + F.get(second, e["state"])["moved"]).alias("moved"),
        ),
    )


def states_before(items: DataFrame, initial: DataFrame, block: int = BLOCK) -> DataFrame:
    """(application_id, seq, effect) → state and number of moves before each item.

    A request is a function from state to state, so requests compose: blocks of ``block``
    consecutive requests are composed independently, the far fewer blocks are folded the same
    way, and the result is handed back down. No task ever sees more than one block of a log.
    """
    key = "application_id"
    blocks = (
        items.withColumn("_block", F.floor(F.col("seq") / block))
        .groupBy(key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "effect"))).alias("_items"))
    )
    longest = items.agg(F.max("seq")).first()[0]
    if longest is None or longest < block:
        started = blocks.join(initial, key)
    else:
        composed = blocks.select(
            key,
            F.col("_block").alias("seq"),
            F.aggregate(
                F.slice("_items", F.lit(2), F.size("_items")),
                F.get("_items", F.lit(0))["effect"],
                lambda acc, item: _then(acc, item["effect"]),
            ).alias("effect"),
        )
        started = blocks.join(
            states_before(composed, initial, block).withColumnRenamed("seq", "_block"), [key, "_block"]
        )
    walked = F.aggregate(
        F.col("_items"),
        F.struct(
            F.col("state").alias("state"),
            F.col("moved").alias("moved"),
            F.array().cast("array<struct<seq:bigint,state:int,moved:bigint>>").alias("out"),
        ),
        lambda acc, item: F.struct(
            F.get(item["effect"], acc["state"])["state"].alias("state"),
            (acc["moved"] + F.get(item["effect"], acc["state"])["moved"]).alias("moved"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        item["seq"].alias("seq"), acc["state"].alias("state"), acc["moved"].alias("moved")
                    )
                ),
            ).alias("out"),
        ),
    )
    return started.select(key, F.inline(walked["out"]))


def apply_moves(
    requests: DataFrame, applications: DataFrame, order: Sequence[str], block: int = BLOCK
) -> DataFrame:
    """Requests in order, each judged against the state the one before left behind.

    Adds from_state, allowed, why and — for moves made — the position of the event they
    append (``last_position`` of the application + 1, + 2, …). Refused moves write no event.
    """
    numbered = number_within(requests, ["application_id"], [F.col(c) for c in order], "seq", start=0)
    names = F.array(*[F.lit(s) for s in STATES])
    initial = applications.select(
        "application_id",
        (F.array_position(names, F.col("state")).cast("int") - 1).alias("state"),
        F.lit(0).cast("bigint").alias("moved"),
    )
    before = states_before(
        numbered.select("application_id", "seq", _effect().alias("effect")), initial, block
    ).select("application_id", "seq", F.get(names, F.col("state")).alias("from_state"), "moved")
    judged = plan_moves(numbered.join(before, ["application_id", "seq"]), "from_state")
    return (
        judged.join(applications.select("application_id", "last_position"), "application_id")
        .withColumn("position", F.when(F.col("allowed"), F.col("last_position") + 1 + F.col("moved")))
        .drop("moved", "last_position")
    )


def follow_screenings(updates: DataFrame, resumes: DataFrame, applications: DataFrame) -> DataFrame:
    """Screening status updates as requests by the system, for the resume owner's application.

    An application is found by (job, owner of the resume): the resume screened need not be
    the one put forward. Updates without an application give no request, which is normal.
    """
    pairs = [F.lit(part) for status, (to, _) in FOLLOWED.items() for part in (status, to)]
    notes = [F.lit(part) for status, (_, note) in FOLLOWED.items() for part in (status, note)]
    owned = updates.join(
        resumes.select("resume_id", F.col("owner_id").alias("candidate_id")), "resume_id"
    )
    return (
        owned.join(applications.select("application_id", "job_id", "candidate_id", "state"), ["job_id", "candidate_id"])
        .withColumn("to_state", F.element_at(F.create_map(*pairs), F.col("status")))
        .withColumn("note", F.element_at(F.create_map(*notes), F.col("status")))
        .where(F.col("to_state").isNotNull())
        .withColumn("mover", F.lit("system"))
        .withColumn("reason", F.lit(None).cast("string"))
    )


def apply_all(
    requests: DataFrame, jobs: DataFrame, resumes: DataFrame, existing: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications created, their first events, requests refused or answered by an older one).

    ``requests``: request_id, at, job_id, candidate_id, role, resume_id. Per (job, candidate)
    the first valid request wins and later ones never swap the resume.
    """
    checked = (
        requests.join(jobs.select("job_id", "status"), "job_id", "left")
        .join(resumes.select("resume_id", "owner_id"), "resume_id", "left")
        .join(
            existing.select("job_id", "candidate_id").withColumn("_exists", F.lit(True)),
            ["job_id", "candidate_id"],
            "left",
        )
        .withColumn(
            "refused",
            F.when(~F.col("status").eqNullSafe(F.lit("published")), "job_not_open")
            .when(~F.col("owner_id").eqNullSafe(F.col("candidate_id")), "resume_not_yours")
            .when(F.col("_exists"), "already_applied"),
        )
        .drop("status", "owner_id", "_exists")
    )
    valid = checked.where(F.col("refused").isNull())
    # An aggregate with map-side combine: a job with any number of requests is no hot spot.
    winners = valid.groupBy("job_id", "candidate_id").agg(
        F.min_by(F.struct("request_id", "resume_id", "role", "at"), F.struct("at", "request_id")).alias("_w")
    )
    created = winners.select(
        F.col("_w.request_id").alias("application_id"),
        "job_id",
        "candidate_id",
        F.col("_w.resume_id").alias("resume_id"),
        F.lit("applied").alias("state"),
        F.col("_w.at").alias("created_at"),
    )
    events = winners.select(
        F.col("_w.request_id").alias("application_id"),
        F.lit(0).alias("position"),
        F.lit(None).cast("string").alias("from_state"),
        F.lit("applied").alias("to_state"),
        F.col("candidate_id").alias("actor_id"),
        F.col("_w.role").alias("actor_role"),
        F.lit("applied").alias("note"),
    )
    later = valid.join(
        winners.select(F.col("_w.request_id").alias("request_id")), "request_id", "left_anti"
    ).withColumn("refused", F.lit("already_applied"))
    return created, events, checked.where(F.col("refused").isNotNull()).unionByName(later)


def completed_screening(applications: DataFrame, screenings: DataFrame) -> DataFrame:
    """The completed screening behind each application, by (job, resume); null without one."""
    done = screenings.where(F.col("status") == "completed").select("job_id", "resume_id", "screening_id")
    return applications.join(done, ["job_id", "resume_id"], "left")


def receipts(
    applications: DataFrame,
    events: DataFrame,
    screenings: DataFrame,
    jobs: DataFrame,
    resumes: DataFrame,
) -> DataFrame:
    """What was read about each applicant: stored verdicts without weights, and what was dropped.

    ``jobs``: job_id, title, specs. Applications without a completed, readable screening have
    no receipt.
    """
    latest = events.groupBy("application_id").agg(F.max_by("reason", "position").alias("reason"))
    done = screenings.where(
        (F.col("status") == "completed") & F.col("requirements").isNotNull()
    ).select("job_id", "resume_id", "screening_id", "requirements", "dropped", "requirements_hash", "updated_at")
    now = jobs.select(
        "job_id",
        "title",
        fingerprint(F.coalesce(F.col("specs"), F.array().cast("array<struct<kind:string,label:string,detail:string>>"))).alias("_now")
        if "current_hash" not in jobs.columns
        else F.col("current_hash").alias("_now"),
    )
    shown = F.transform(
        "requirements",
        lambda r: F.struct(
            r["label"].alias("label"),
            r["must_have"].alias("must_have"),
            r["verdict"].alias("verdict"),
            r["evidence"].alias("evidence"),
        ),
    )
    return (
        applications.join(done, ["job_id", "resume_id"])
        .join(now, "job_id")
        .join(resumes.select("resume_id", "text"), "resume_id")
        .join(latest, "application_id", "left")
        .select(
            "application_id",
            F.col("title").alias("job_title"),
            "state",
            "reason",
            F.col("updated_at").alias("screened_at"),
            shown.alias("requirements"),
            "dropped",
            F.col("text").alias("document_text"),
            (
                F.col("requirements_hash").isNotNull() & (F.col("requirements_hash") != F.col("_now"))
            ).alias("posting_changed_since"),
        )
    )
