"""Requirements put to documents: verdicts follow from located quotes and from nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators import evidence as ev
from sourcemark.operators.joins import attach
from sourcemark.session import settle

# The two verdicts there are.
MET = "met"
NOT_EVIDENCED = "not_evidenced"

SPEC = "struct<id:string,label:string,kind:string,detail:string,must_have:boolean,weight:double>"


def requirement_specs(requirements: DataFrame) -> DataFrame:
    """job_id, specs: the job's requirements in (position, created_at) order.

    The requirement checks allow at most 30 per job, so the array is bounded.
    """
    fields = ["id", "label", "kind", "detail", "must_have", "weight"]
    return requirements.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "created_at", *fields))),
            lambda r: F.struct(*[r[f].alias(f) for f in fields]),
        ).alias("specs")
    )


def fingerprint(specs: Column) -> Column:
    """SHA-256 of the compact JSON of [kind, label, detail or ""] in order.

    Ids, must_have and weight are left out: they cannot change a verdict.
    """
    asked = F.transform(
        specs,
        lambda s: F.array(s["kind"], s["label"], F.coalesce(s["detail"], F.lit(""))),
    )
    return F.sha2(F.to_json(asked), 256)


def group_matches(raw: DataFrame, specs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per proposed quote, in answer order, known numbers and unknown ones alike.

    ``raw``: keys (including job_id) and ``matches`` array<struct<requirement, quotes>>.
    ``quote_no`` follows the verification order: by requirement, repeated numbers merged in
    the order given; numbers nobody asked for come first, marked ``unknown_requirement``.
    """
    quotes = (
        raw.join(specs, "job_id", "left")
        .select(*keys, "specs", F.posexplode("matches").alias("_match_no", "_match"))
        .select(
            *keys,
            "specs",
            "_match_no",
            F.col("_match.requirement").alias("requirement"),
            F.posexplode("_match.quotes").alias("_in_match", "quote"),
        )
    )
    total = F.coalesce(F.size("specs"), F.lit(0))
    known = (F.col("requirement") >= 1) & (F.col("requirement") <= total)
    number = F.col("requirement").cast("string")
    spec = F.get("specs", F.col("requirement") - 1)
    return quotes.select(
        *keys,
        "requirement",
        known.alias("known"),
        F.struct(
            F.when(known, F.col("requirement")).otherwise(0).alias("requirement"), "_match_no", "_in_match"
        ).alias("quote_no"),
        F.when(known, F.concat(F.lit("requirements["), (F.col("requirement") - 1).cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("matches[requirement="), number, F.lit("]")))
        .alias("field"),
        F.when(known, spec["label"]).otherwise(F.concat(F.lit("requirement "), number)).alias("value"),
        "quote",
    )


def resolve_matches(raw: DataFrame, specs: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every proposed quote with its outcome; unattributable ones are not searched for."""
    quotes = group_matches(raw, specs, keys)
    found = ev.resolve(quotes.where(F.col("known")), docs)
    refused = quotes.where(~F.col("known")).withColumn("reason", F.lit(ev.REJECT_REASONS[3]))
    return found.unionByName(refused, allowMissingColumns=True)


NO_TEXT = "no_text"


def split_screenable(raw: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers to documents with text, answers whose document has none)."""
    texts = docs.select("doc_id", has_text(F.col("text")).alias("_text"))
    # Written once: both halves and the judging read the answers again.
    known = settle(attach(raw, texts, ["doc_id"]))
    ready = F.coalesce(F.col("_text"), F.lit(True))
    return known.where(ready).drop("_text"), known.where(~ready).drop("_text")


def judge(raw: DataFrame, specs: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One judgment per row of ``raw``: requirements in order, dropped quotes, counters.

    A requirement is met when at least one quote was located. Jobs without requirements give
    an empty judgment. A document without text is not judged but reported by ``refusal``: to call
    its requirements not evidenced would be a wrong statement. All regrouped arrays are bounded
    by the answer row they came from.
    """
    ready, textless = split_screenable(raw, docs)
    judged = _judgments(ready, specs, docs, keys).withColumn("refusal", F.lit(None).cast("string"))
    empty = {name: F.array().cast(judged.schema[name].dataType) for name in ("requirements", "dropped")}
    zero = ("requirements_met", "requirements_total", "claims_verified", "claims_dropped", "hallucination_rate")
    refused = textless.select(
        *keys,
        *[column.alias(name) for name, column in empty.items()],
        *[F.lit(0).cast(judged.schema[name].dataType).alias(name) for name in zero],
        F.lit(NO_TEXT).alias("refusal"),
    )
    return judged.unionByName(refused)


def _judgments(raw: DataFrame, specs: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    resolved = resolve_matches(raw, specs, docs, keys)
    kept = F.col("reason").isNull()
    outcomes = resolved.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.when(kept, F.struct("quote_no", "requirement", ev.span_of().alias("span"))))
        ).alias("_kept"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(~kept, F.struct("quote_no", "field", "value", "quote", "reason")))
            ),
            lambda d: F.struct(*[d[f].alias(f) for f in ("field", "value", "quote", "reason")]),
        ).alias("dropped"),
        F.count_if(kept).alias("claims_verified"),
        F.count_if(~kept).alias("claims_dropped"),
    )
    no_spans = F.array().cast(f"array<{ev.SPAN}>")
    joined = (
        raw.select(*keys)
        .join(specs, "job_id", "left")
        .join(outcomes, list(keys), "left")
        .withColumn("_specs", F.coalesce(F.col("specs"), F.array().cast(f"array<{SPEC}>")))
    )
    requirements = F.transform(
        F.col("_specs"),
        lambda spec, at: _judged(
            spec,
            F.coalesce(
                F.transform(
                    F.filter("_kept", lambda k: k["requirement"] == at + 1), lambda k: k["span"]
                ),
                no_spans,
            ),
        ),
    )
    verified, dropped = (F.coalesce(F.col(c), F.lit(0)) for c in ("claims_verified", "claims_dropped"))
    no_drops = F.array().cast("array<struct<field:string,value:string,quote:string,reason:string>>")
    return joined.withColumn("requirements", requirements).select(
        *keys,
        "requirements",
        F.coalesce(F.col("dropped"), no_drops).alias("dropped"),
        met_count(F.col("requirements")).alias("requirements_met"),
        F.size("requirements").alias("requirements_total"),
        verified.alias("claims_verified"),
        dropped.alias("claims_dropped"),
        ev.claim_rate(dropped, verified + dropped).alias("hallucination_rate"),
    )


def _judged(spec: Column, spans: Column) -> Column:
    return F.struct(
        spec["id"].alias("requirement_id"),
        spec["label"].alias("label"),
        spec["must_have"].alias("must_have"),
        spec["weight"].alias("weight"),
        F.when(F.size(spans) > 0, MET).otherwise(NOT_EVIDENCED).alias("verdict"),
        spans.alias("evidence"),
    )


def met_count(requirements: Column) -> Column:
    return F.size(F.filter(requirements, lambda r: r["verdict"] == MET))


def is_stale(stored_hash: Column, stored_prompt: Column, now_hash: Column, now_prompt: Column) -> Column:
    """Whether a stored answer is to another question; a missing hash always is."""
    return ~(stored_hash.eqNullSafe(now_hash) & stored_prompt.eqNullSafe(now_prompt))


def stale_screenings(screenings: DataFrame, current: DataFrame, prompt: str) -> DataFrame:
    """Screenings with ``is_stale``; only a completed one can be."""
    stale = is_stale(
        F.col("requirements_hash"), F.col("prompt_version"), F.col("current_hash"), F.lit(prompt)
    )
    return screenings.join(current, "job_id", "left").withColumn(
        "is_stale", (F.col("status") == "completed") & stale
    )


def has_text(text: Column) -> Column:
    """What judging needs: a document with at least one character."""
    return F.coalesce(text, F.lit("")) != ""


def pairs_to_screen(
    pairs: DataFrame, screenings: DataFrame, current: DataFrame, prompt: str, force: Column | None = None
) -> DataFrame:
    """Requested (job_id, resume_id) with ``decision``: run_new, run, stale, held, current, forced."""
    known = screenings.select(
        "job_id",
        "resume_id",
        F.col("status").alias("_status"),
        F.col("requirements_hash").alias("_hash"),
        F.col("prompt_version").alias("_prompt"),
    )
    joined = pairs.join(known, ["job_id", "resume_id"], "left").join(current, "job_id", "left")
    stale = is_stale(F.col("_hash"), F.col("_prompt"), F.col("current_hash"), F.lit(prompt))
    decision = (
        F.when(F.col("_status").isNull(), "run_new")
        .when(F.lit(False) if force is None else force, "forced")
        .when(F.col("_status") == "processing", "held")
        .when((F.col("_status") == "completed") & stale, "stale")
        .when(F.col("_status") == "completed", "current")
        .otherwise("run")
    )
    return (
        joined.withColumn("decision", decision)
        .withColumn("queued", ~F.col("decision").isin("held", "current"))
        .drop("_status", "_hash", "_prompt", "current_hash")
    )


def edit_impact(old: DataFrame, new: DataFrame, screenings: DataFrame) -> DataFrame:
    """Per job: does the change touch what the judge is shown, and how many results would it void?"""
    before = old.select("job_id", "id", F.struct("kind", "label", "detail").alias("_old"))
    after = new.select("job_id", "id", F.struct("kind", "label", "detail").alias("_new"))
    touched = (
        before.join(after, ["job_id", "id"], "full")
        .groupBy("job_id")
        .agg(F.bool_or(~F.col("_old").eqNullSafe(F.col("_new"))).alias("stalening"))
    )
    done = screenings.groupBy("job_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed")
    )
    lost = F.when(F.col("stalening"), F.coalesce(F.col("completed"), F.lit(0))).otherwise(0)
    return touched.join(done, "job_id", "left").select("job_id", "stalening", lost.alias("invalidated"))
