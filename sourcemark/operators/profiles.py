"""Raw profiles (values with quotes) into verified profiles, and choices between attempts.

A raw profile is one row with nested claims, so everything regrouped per document below is
bounded by the row it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.operators import evidence as ev

CLAIM = "struct<value:string,quote:string>"
# The raw profile, field by field; unknown fields are refused by the strict reader.
RAW_PROFILE = (
    "doc_id bigint, full_name {c}, headline {c}, years_experience {c}, seniority string, "
    "seniority_quote string, skills array<struct<name:string,quote:string>>, "
    "experiences array<struct<company:string,title:string,start:string,end:string,quote:string>>, "
    "education array<struct<institution:string,credential:string,quote:string>>"
).format(c=CLAIM)
# The levels a profile may state, and the one that needs no quote.
SENIORITY = ("junior", "mid", "senior", "lead", "unknown")
UNKNOWN = "unknown"

_CLAIMS = "array<struct<field:string,value:string,quote:string>>"


def _one(field: str) -> Column:
    claim = F.struct(
        F.lit(field).alias("field"), F.col(field)["value"].alias("value"), F.col(field)["quote"].alias("quote")
    )
    return F.when(F.col(field).isNotNull(), F.array(claim)).otherwise(F.array().cast(_CLAIMS))


def _many(field: str, value) -> Column:
    items = F.transform(
        F.col(field),
        lambda item, at: F.struct(
            F.concat(F.lit(f"{field}["), at.cast("string"), F.lit("]")).alias("field"),
            value(item).alias("value"),
            item["quote"].alias("quote"),
        ),
    )
    return F.coalesce(items, F.array().cast(_CLAIMS))


def flatten_profile(raw: DataFrame) -> DataFrame:
    """One row per claim, in the fixed field order: doc_id, claim_no, field, value, quote."""
    level = F.when(
        F.coalesce(F.col("seniority"), F.lit(UNKNOWN)) != UNKNOWN,
        F.array(
            F.struct(
                F.lit("seniority").alias("field"),
                F.col("seniority").alias("value"),
                F.coalesce(F.col("seniority_quote"), F.lit("")).alias("quote"),
            )
        ),
    ).otherwise(F.array().cast(_CLAIMS))
    claims = F.concat(
        _one("full_name"),
        _one("headline"),
        _one("years_experience"),
        level,
        _many("skills", lambda s: s["name"]),
        _many("experiences", lambda e: F.concat(e["title"], F.lit(" at "), e["company"])),
        _many("education", lambda e: F.concat(e["credential"], F.lit(", "), e["institution"])),
    )
    return raw.select("doc_id", F.posexplode(claims).alias("claim_no", "claim")).select(
        "doc_id", "claim_no", "claim.*"
    )


def verified_profile(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """The profile with only what the document backs, plus what was dropped and the counters."""
    resolved = ev.resolve(flatten_profile(raw), docs)
    span = F.when(F.col("reason").isNull(), ev.span_of())
    outcomes = resolved.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(F.struct("claim_no", span.alias("span"), "field", "value", "quote", "reason"))
        ).alias("_claims"),
        *ev.counters(),
    )
    joined = raw.join(outcomes, "doc_id", "left")

    # Claims are numbered in field order, so each field knows where its own begin. Kept as
    # columns: inside a lambda, a name would mean the output field of the same name.
    at = F.lit(0)
    stated = F.coalesce(F.col("seniority"), F.lit(UNKNOWN)) != UNKNOWN
    for field in ("full_name", "headline", "years_experience", "seniority", "skills", "experiences", "education"):
        joined = joined.withColumn(f"_at_{field}", at)
        if field == "seniority":
            at = at + stated.cast("int")
        elif field in ("skills", "experiences"):
            at = at + F.coalesce(F.size(field), F.lit(0))
        else:
            at = at + F.col(field).isNotNull().cast("int")

    def span_at(position: Column) -> Column:
        return F.get("_claims", position)["span"]

    def single(field: str) -> Column:
        found = F.when(F.col(field).isNotNull(), span_at(F.col(f"_at_{field}")))
        return F.when(
            found.isNotNull(), F.struct(F.col(field)["value"].alias("value"), found.alias("evidence"))
        ).alias(field)

    def several(field: str, names: Sequence[tuple[str, str]]) -> Column:
        items = F.transform(
            F.col(field),
            lambda item, nth: F.struct(
                *[item[source].alias(name) for source, name in names],
                span_at(F.col(f"_at_{field}") + nth).alias("evidence"),
            ),
        )
        return F.filter(items, lambda item: item["evidence"].isNotNull()).alias(field)

    level = F.when(stated, span_at(F.col("_at_seniority")))
    lost = F.transform(
        F.filter("_claims", lambda c: c["reason"].isNotNull()),
        lambda c: F.struct(*[c[f].alias(f) for f in ("field", "value", "quote", "reason")]),
    )
    no_drops = F.array().cast("array<struct<field:string,value:string,quote:string,reason:string>>")
    return joined.select(
        "doc_id",
        single("full_name"),
        single("headline"),
        single("years_experience"),
        F.when(level.isNotNull(), F.col("seniority")).otherwise(UNKNOWN).alias("seniority"),
        level.alias("seniority_evidence"),
        several("skills", [("name", "value")]),
        several("experiences", [(n, n) for n in ("company", "title", "start", "end")]),
        several("education", [(n, n) for n in ("institution", "credential")]),
        F.coalesce(lost, no_drops).alias("dropped"),
        F.struct(*ev.stats_of()).alias("stats"),
    )


def cited() -> Column:
    """Every citation of a verified profile's row, in display order; dropped claims have none."""
    singles = [F.col(c)["evidence"] for c in ("full_name", "headline", "years_experience")]
    lists = [
        F.coalesce(F.transform(F.col(c), lambda i: i["evidence"]), F.array().cast(f"array<{ev.SPAN}>"))
        for c in ("skills", "experiences", "education")
    ]
    everything = F.concat(F.array(*singles, F.col("seniority_evidence")), *lists)
    return F.filter(everything, lambda s: s.isNotNull())


def profile_evidence(profiles: DataFrame) -> DataFrame:
    """The citations of each profile, by document."""
    return profiles.select("doc_id", cited().alias("refs"))


def judgment_evidence(judgments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Citations of met requirements only, whatever else the stored row carries."""
    met = F.filter("requirements", lambda r: r["verdict"] == "met")
    return judgments.select(*keys, F.flatten(F.transform(met, lambda r: r["evidence"])).alias("refs"))


def segments(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Alternating plain and cited slices of each document.

    Earliest, longest citations win and overlapping ones are skipped: a greedy pass over the
    document's own sorted citations.
    """
    size = F.char_length("text")
    valid = F.filter(
        F.coalesce(F.col("refs"), F.array().cast(f"array<{ev.SPAN}>")),
        lambda r: (r["char_start"] >= 0) & (r["char_end"] > r["char_start"]) & (r["char_end"] <= size),
    )
    ordered = F.array_sort(
        F.transform(
            valid,
            lambda r: F.struct(
                r["char_start"].alias("start"), (-r["char_end"]).alias("back"), r["is_ambiguous"].alias("amb")
            ),
        )
    )
    empty = F.array().cast("array<struct<start:int,end:int,cited:boolean,ambiguous:boolean>>")

    def piece(start: Column, end: Column, cited: bool, ambiguous: Column) -> Column:
        return F.struct(
            start.alias("start"), end.alias("end"), F.lit(cited).alias("cited"), ambiguous.alias("ambiguous")
        )

    def step(acc: Column, ref: Column) -> Column:
        gap = F.when(
            ref["start"] > acc["cursor"],
            F.array(piece(acc["cursor"], ref["start"], False, F.lit(None).cast("boolean"))),
        ).otherwise(empty)
        taken = ref["start"] >= acc["cursor"]
        cited = F.array(piece(ref["start"], -ref["back"], True, ref["amb"]))
        return F.struct(
            F.when(taken, -ref["back"]).otherwise(acc["cursor"]).alias("cursor"),
            F.when(taken, F.concat(acc["out"], gap, cited)).otherwise(acc["out"]).alias("out"),
        )

    walked = F.aggregate(ordered, F.struct(F.lit(0).alias("cursor"), empty.alias("out")), step)
    tail = F.when(
        F.col("_w")["cursor"] < size,
        F.array(piece(F.col("_w")["cursor"], size, False, F.lit(None).cast("boolean"))),
    ).otherwise(empty)
    return (
        docs.select("doc_id", "text")
        .join(refs.select("doc_id", "refs"), "doc_id", "left")
        .withColumn("_w", walked)
        .select("doc_id", "text", F.posexplode(F.concat(F.col("_w")["out"], tail)).alias("segment_no", "s"))
        .select(
            "doc_id",
            "segment_no",
            F.col("s.start").alias("char_start"),
            F.col("s.end").alias("char_end"),
            F.col("s.cited").alias("cited"),
            F.col("s.ambiguous").alias("is_ambiguous"),
            F.substr(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"),
        )
    )


def best_attempt(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fewest dropped claims, earliest on ties; ``calls`` counts attempts up to the first clean one.

    A clean attempt has the minimum by definition, so nothing after it can win and one
    aggregate with map-side combine decides.
    """
    clean = F.when(F.col("dropped") == 0, F.col("attempt"))
    return attempts.groupBy(*by).agg(
        F.min_by("attempt", F.struct("dropped", "attempt")).alias("attempt"),
        F.min("dropped").alias("dropped"),
        F.coalesce(F.min(clean), F.max("attempt")).alias("calls"),
    )


def best_judgment(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most requirements met, then fewest dropped, then earliest, among attempts actually made."""
    clean = F.when(F.col("dropped") == 0, F.col("attempt"))
    stops = attempts.groupBy(*by).agg(F.coalesce(F.min(clean), F.max("attempt")).alias("_stop"))
    order = F.struct((-F.col("met")).alias("met"), F.col("dropped"), F.col("attempt"))
    return (
        attempts.join(stops, list(by))
        .where(F.col("attempt") <= F.col("_stop"))
        .groupBy(*by)
        .agg(
            F.min_by(F.struct("attempt", "met", "dropped"), order).alias("_best"),
            F.max("_stop").alias("calls"),
        )
        .select(*by, "_best.attempt", "_best.met", "_best.dropped", "calls")
    )
