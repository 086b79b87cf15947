"""Registered queries over `documents`: locating quotes, counters, profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sourcemark.operators import evidence as ev
from sourcemark.operators import profiles as pf
from sourcemark.plans.common import WS, DataFrame, SparkSession, sql_round, table
from sourcemark.session import use_checkpoint_dir
from sourcemark.sources.placed import Placed, bundles, store_placed

_AT = "(1 + (doc_id * 7919) % greatest(1, length(text) - 60))"


def _claims(docs: DataFrame) -> DataFrame:
    """Six claims per document, cut from anywhere in it and bent in six ways."""
    s = F.expr(f"substr(text, {_AT}, 60)")
    bent = F.array(
        s,
        F.regexp_replace(s, " ", "\n  "),
        F.replace(s, F.lit(" "), F.lit("")),
        F.concat(F.lit("zqx "), s),
        F.substr(s, F.lit(1), F.lit(3)),
        F.lit(" \n "),
    )
    return docs.select(
        "doc_id", "source", F.posexplode(bent).alias("claim_no", "quote")
    ).withColumn("claim_no", F.col("claim_no").cast("bigint"))


# The same claims in SQL, resolved by brute force: one pass over every text per claim.
_CLAIMS_SQL = rf"""
WITH s AS (SELECT doc_id, source, text, substr(text, {_AT}, 60) AS s FROM documents),
c AS (
  SELECT doc_id, source, text, 0::BIGINT AS claim_no, s AS quote FROM s
  UNION ALL SELECT doc_id, source, text, 1, replace(s, ' ', chr(10) || '  ') FROM s
  UNION ALL SELECT doc_id, source, text, 2, replace(s, ' ', '') FROM s
  UNION ALL SELECT doc_id, source, text, 3, 'zqx ' || s FROM s
  UNION ALL SELECT doc_id, source, text, 4, substr(s, 1, 3) FROM s
  UNION ALL SELECT doc_id, source, text, 5, ' ' || chr(10) || ' ' FROM s),
q AS (
  SELECT *, regexp_replace(regexp_replace(nfc_normalize(quote), '^{WS}+', ''), '{WS}+$', '') AS q FROM c),
w AS (
  SELECT *, regexp_replace(q, '{WS}+', ' ', 'g') AS cq, regexp_replace(q, '{WS}+', '', 'g') AS sq,
    trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS ct, regexp_replace(text, '{WS}+', '', 'g') AS st
  FROM q),
k AS (
  SELECT *, CASE WHEN q = '' THEN 'empty' WHEN length(q) < 4 THEN 'too_short' END AS why FROM w),
m AS (
  SELECT *, CASE WHEN why IS NOT NULL THEN NULL WHEN contains(text, q) THEN 'exact'
    WHEN contains(ct, cq) THEN 'whitespace_collapsed'
    WHEN length(sq) >= 8 AND contains(st, sq) THEN 'whitespace_stripped' END AS match_kind FROM k),
h AS (
  SELECT *, CASE match_kind WHEN 'exact' THEN q
    WHEN 'whitespace_collapsed' THEN regexp_extract(text, replace(regexp_escape(cq), '\ ', '{WS}+'))
    WHEN 'whitespace_stripped' THEN regexp_extract(text,
      array_to_string(list_transform(string_split(sq, ''), lambda x: regexp_escape(x)), '{WS}*')) END AS found
  FROM m),
r AS (
  SELECT doc_id, source, claim_no, quote, found, (strpos(text, found) - 1)::INTEGER AS char_start,
    (strpos(text, found) - 1 + length(found))::INTEGER AS char_end, match_kind,
    least(8, CASE match_kind WHEN 'exact' THEN (length(text) - length(replace(text, q, ''))) // length(q)
      WHEN 'whitespace_collapsed' THEN (length(ct) - length(replace(ct, cq, ''))) // length(cq)
      WHEN 'whitespace_stripped' THEN (length(st) - length(replace(st, sq, ''))) // length(sq) END)::INTEGER
      AS occurrences,
    coalesce(why, CASE WHEN match_kind IS NULL THEN 'not_found' END) AS reason
  FROM h)
"""


# A reader is told of at most so many occurrences.
TOLD = 8


def resolve_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim placed; page boundaries stand every 1000 characters."""
    docs = table(spark, sf_dir, "documents")
    return _shown(ev.resolve(_claims(docs), _paged(docs)))


def resolve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tables stored by document: neither texts nor claims are exchanged, but for hot documents."""
    use_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/placed-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    stored = {
        name: store_placed(rows, f"{root}/{name}", "doc_id", 8) for name, rows in (("docs", _paged(docs)), ("claims", _claims(docs)))
    }
    claims, texts = stored["claims"], stored["docs"]
    columns = [c for c in claims.even.columns if c != "doc_id"]
    nested = bundles(
        Placed("doc_id", ev.read_quotes(claims.even), ev.read_quotes(claims.hot)),
        Placed("doc_id", ev.as_sources(texts.even), ev.as_sources(texts.hot)),
        "_claims",
    )
    return _shown(ev.place_bundles(nested, columns))


def _paged(docs: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(1000))
    pages = F.transform(
        starts, lambda at: F.struct((at / 1000 + 1).cast("int").alias("page_number"), at.alias("char_start"), (at + 1000).alias("char_end"))
    )
    return docs.select("doc_id", "text", pages.alias("pages"))


def _shown(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "doc_id", "claim_no", "quote", "found", "char_start", "char_end", "match_kind",
        F.when(F.col("occurrences") > TOLD, TOLD).otherwise(F.col("occurrences")).alias("occurrences"),
        "is_ambiguous", "page", "reason",
    )


RESOLVE_CLAIMS = (
    _CLAIMS_SQL
    + """SELECT doc_id, claim_no, quote, found, char_start, char_end, match_kind,
  CASE WHEN found IS NULL THEN NULL ELSE occurrences END AS occurrences,
  CASE WHEN found IS NULL THEN NULL ELSE occurrences > 1 END AS is_ambiguous,
  CASE WHEN found IS NULL THEN NULL ELSE (char_start // 1000 + 1)::INTEGER END AS page, reason FROM r"""
)


def evidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = ev.evidence_stats(ev.resolve(_claims(docs), docs.select("doc_id", "text")), ["source"])
    n = lambda c, k: F.coalesce(F.col(c)[F.lit(k)], F.lit(0)).cast("bigint").alias(k)
    return stats.select(
        "source",
        "verified",
        "dropped",
        "total_claims",
        *[n("by_match_kind", k) for k in ev.MATCH_KINDS],
        *[n("by_reject_reason", k) for k in ev.REJECT_REASONS[:3]],
        "hallucination_rate",
    )


EVIDENCE_STATS = (
    _CLAIMS_SQL
    + f""", g AS (SELECT source, count(*) FILTER (reason IS NULL) AS verified,
  count(*) FILTER (reason IS NOT NULL) AS dropped, count(*) AS total_claims,
  count(*) FILTER (match_kind = 'exact') AS exact,
  count(*) FILTER (match_kind = 'whitespace_collapsed') AS whitespace_collapsed,
  count(*) FILTER (match_kind = 'whitespace_stripped') AS whitespace_stripped,
  count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'too_short') AS too_short,
  count(*) FILTER (reason = 'not_found') AS not_found FROM r GROUP BY source)
SELECT *, {sql_round("(dropped::DOUBLE / total_claims)", 4)} AS hallucination_rate FROM g"""
)


def split_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the verification counted beside the claims they came from."""
    docs = table(spark, sf_dir, "documents")
    resolved = ev.resolve(_claims(docs), docs.select("doc_id", "text"))
    verified, dropped = ev.split_outcomes(resolved)
    kept = verified.select("doc_id", F.lit(1).alias("v"), F.lit(0).alias("d"), F.lit(0).alias("quoted"))
    lost = dropped.select("doc_id", F.lit(0).alias("v"), F.lit(1).alias("d"), F.char_length("quote").alias("quoted"))
    return (
        kept.unionByName(lost)
        .groupBy("doc_id")
        .agg(F.sum("v").alias("verified"), F.sum("d").alias("dropped"), F.sum("quoted").alias("dropped_chars"))
    )


SPLIT_OUTCOMES = (
    _CLAIMS_SQL
    + """SELECT doc_id, count(*) FILTER (reason IS NULL) AS verified,
  count(*) FILTER (reason IS NOT NULL) AS dropped,
  coalesce(sum(length(quote)) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped_chars
FROM r GROUP BY doc_id"""
)


def _raw_profiles(docs: DataFrame) -> DataFrame:
    """A raw profile per document: true, bent and invented claims in every field."""
    s = F.expr(f"substr(text, {_AT}, 60)")
    claim = lambda v, q: F.struct(v.alias("value"), q.alias("quote"))
    level = F.element_at(F.array(*[F.lit(x) for x in pf.SENIORITY]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 4 != 0, claim(F.lit("n"), s)).alias("full_name"),
        claim(F.lit("h"), F.concat(F.lit("zqx "), s)).alias("headline"),
        F.lit(None).cast("struct<value:string,quote:string>").alias("years_experience"),
        level.alias("seniority"),
        F.when(F.col("doc_id") % 3 == 0, s).otherwise("zqx").alias("seniority_quote"),
        F.array(
            F.struct(F.lit("a").alias("name"), F.regexp_replace(s, " ", "\n  ").alias("quote")),
            F.struct(F.lit("b").alias("name"), F.lit("zqxzqx").alias("quote")),
            F.struct(F.lit("c").alias("name"), s.alias("quote")),
        ).alias("skills"),
        F.array(
            F.struct(
                F.lit("co").alias("company"), F.lit("ti").alias("title"), F.lit("1").alias("start"),
                F.lit("2").alias("end"), F.replace(s, F.lit(" "), F.lit("")).alias("quote"),
            )
        ).alias("experiences"),
        F.array(
            F.struct(F.lit("in").alias("institution"), F.lit("cr").alias("credential"), F.lit(" ").alias("quote"))
        ).alias("education"),
    )


def flatten_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pf.flatten_profile(_raw_profiles(docs)).withColumn("claim_no", F.col("claim_no").cast("bigint"))


_PROFILE_SQL = rf"""
WITH s AS (SELECT doc_id, text, substr(text, {_AT}, 60) AS s,
    ['junior','mid','senior','lead','unknown'][(doc_id % 5 + 1)::INTEGER] AS seniority FROM documents),
f AS (
  SELECT doc_id, 1 AS o, 'full_name' AS field, 'n' AS value, s AS quote FROM s WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 2, 'headline', 'h', 'zqx ' || s FROM s
  UNION ALL SELECT doc_id, 3, 'seniority', seniority, CASE WHEN doc_id % 3 = 0 THEN s ELSE 'zqx' END FROM s
    WHERE seniority <> 'unknown'
  UNION ALL SELECT doc_id, 4, 'skills[0]', 'a', replace(s, ' ', chr(10) || '  ') FROM s
  UNION ALL SELECT doc_id, 5, 'skills[1]', 'b', 'zqxzqx' FROM s
  UNION ALL SELECT doc_id, 6, 'skills[2]', 'c', s FROM s
  UNION ALL SELECT doc_id, 7, 'experiences[0]', 'ti at co', replace(s, ' ', '') FROM s
  UNION ALL SELECT doc_id, 8, 'education[0]', 'cr, in', ' ' FROM s)
"""
FLATTEN_PROFILE = (
    _PROFILE_SQL
    + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS claim_no, field, value, quote FROM f"
)


def verified_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = pf.verified_profile(_raw_profiles(docs), docs.select("doc_id", "text"))
    names = lambda c, f: F.array_join(F.transform(c, lambda i: i[f]), ",").alias(c)
    return p.select(
        "doc_id",
        F.col("full_name.value").alias("full_name"),
        F.col("full_name.evidence.char_start").alias("name_start"),
        F.col("headline.value").alias("headline"),
        "seniority",
        names("skills", "value"),
        names("experiences", "company"),
        names("education", "institution"),
        F.array_join(F.transform("dropped", lambda d: F.concat(d["field"], F.lit("="), d["reason"])), ",").alias(
            "dropped"
        ),
        F.col("stats.verified").alias("verified"),
        F.col("stats.hallucination_rate").alias("hallucination_rate"),
        F.size(pf.cited()).cast("bigint").alias("refs"),
    )


VERIFIED_PROFILE = (
    _PROFILE_SQL
    + rf""",
q AS (SELECT f.*, s.text, regexp_replace(regexp_replace(quote, '^{WS}+', ''), '{WS}+$', '') AS q FROM f JOIN s USING (doc_id)),
v AS (SELECT *, CASE WHEN q = '' THEN 'empty' WHEN length(q) < 4 THEN 'too_short'
    WHEN contains(text, q) OR contains(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), regexp_replace(q, '{WS}+', ' ', 'g'))
      OR (length(regexp_replace(q, '{WS}+', '', 'g')) >= 8
        AND contains(regexp_replace(text, '{WS}+', '', 'g'), regexp_replace(q, '{WS}+', '', 'g'))) THEN NULL
    ELSE 'not_found' END AS reason FROM q),
g AS (SELECT doc_id,
  max(value) FILTER (field = 'full_name' AND reason IS NULL) AS full_name,
  max(strpos(text, q) - 1) FILTER (field = 'full_name' AND reason IS NULL)::INTEGER AS name_start,
  max(value) FILTER (field = 'headline' AND reason IS NULL) AS headline,
  coalesce(max(value) FILTER (field = 'seniority' AND reason IS NULL), 'unknown') AS seniority,
  coalesce(string_agg(value, ',' ORDER BY o) FILTER (field LIKE 'skills%' AND reason IS NULL), '') AS skills,
  CASE WHEN count(*) FILTER (field = 'experiences[0]' AND reason IS NULL) > 0 THEN 'co' ELSE '' END AS experiences,
  CASE WHEN count(*) FILTER (field = 'education[0]' AND reason IS NULL) > 0 THEN 'in' ELSE '' END AS education,
  coalesce(string_agg(field || '=' || reason, ',' ORDER BY o) FILTER (reason IS NOT NULL), '') AS dropped,
  count(*) FILTER (reason IS NULL) AS verified, count(*) AS total FROM v GROUP BY doc_id)
SELECT * EXCLUDE (total), {sql_round("((total - verified)::DOUBLE / total)", 4)} AS hallucination_rate, verified AS refs FROM g"""
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and cited slices; each document cites six spans of which several overlap."""
    docs = table(spark, sf_dir, "documents")
    n = F.char_length("text")
    start = lambda i: ((F.col("doc_id") * 31 + i * 17) % F.greatest(F.lit(1), n)).cast("int")
    spans = F.array(
        *[
            F.struct(
                F.lit("").alias("quote"),
                start(i).alias("char_start"),
                (start(i) + 10 + 5 * (i % 3)).cast("int").alias("char_end"),
                F.lit(1).alias("page"),
                F.lit("exact").alias("match_kind"),
                F.lit(i % 2 == 0).alias("is_ambiguous"),
            )
            for i in range(6)
        ]
    )
    out = pf.segments(docs, docs.select("doc_id", spans.alias("refs")))
    return out.select(
        "doc_id",
        F.col("segment_no").cast("bigint").alias("segment_no"),
        "char_start",
        "char_end",
        "cited",
        F.sha2("text", 256).alias("text_hash"),
    )


SEGMENTS = """
WITH RECURSIVE refs AS (
  SELECT doc_id, length(text) AS n, i,
    ((doc_id * 31 + i * 17) % greatest(1, length(text)))::INTEGER AS s,
    ((doc_id * 31 + i * 17) % greatest(1, length(text)) + 10 + 5 * (i % 3))::INTEGER AS e
  FROM documents, range(6) t(i)),
o AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS k
  FROM (SELECT DISTINCT doc_id, s, e FROM refs WHERE e <= n)),
walk AS (
  SELECT doc_id, 0 AS k, 0 AS cur, NULL::INTEGER AS s, NULL::INTEGER AS e, 0 AS was FROM documents
  UNION ALL
  SELECT w.doc_id, o.k, CASE WHEN o.s >= w.cur THEN o.e ELSE w.cur END,
    CASE WHEN o.s >= w.cur THEN o.s END, CASE WHEN o.s >= w.cur THEN o.e END, w.cur
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
fin AS (SELECT doc_id, max(cur) AS cur FROM walk GROUP BY doc_id),
parts AS (
  SELECT doc_id, was AS char_start, s AS char_end, false AS cited FROM walk WHERE s > was
  UNION ALL SELECT doc_id, s, e, true FROM walk WHERE s IS NOT NULL
  UNION ALL SELECT f.doc_id, cur, length(text)::INTEGER, false FROM fin f JOIN documents d USING (doc_id) WHERE cur < length(text))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS segment_no, char_start, char_end, cited,
  sha256(substr(text, char_start + 1, char_end - char_start)) AS text_hash
FROM parts JOIN documents USING (doc_id)"""


def _attempts(docs: DataFrame) -> DataFrame:
    """Three recorded attempts per document with pseudo-random outcomes."""
    return docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt")).select(
        "doc_id",
        "attempt",
        ((F.col("doc_id") * 13 + F.col("attempt") * 7) % 5).cast("int").alias("met"),
        ((F.col("doc_id") * 11 + F.col("attempt") * 5) % 4).cast("int").alias("dropped"),
    )


_ATTEMPTS_SQL = """
WITH a AS (SELECT doc_id, i::INTEGER AS attempt, ((doc_id * 13 + i * 7) % 5)::INTEGER AS met,
    ((doc_id * 11 + i * 5) % 4)::INTEGER AS dropped FROM documents, range(1, 4) t(i)),
made AS (SELECT *, coalesce(bool_or(dropped = 0) OVER (PARTITION BY doc_id ORDER BY attempt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM a)
"""


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.best_attempt(_attempts(table(spark, sf_dir, "documents")), ["doc_id"])


BEST_ATTEMPT = (
    _ATTEMPTS_SQL
    + """SELECT doc_id, arg_min(attempt, (dropped, attempt)) AS attempt, min(dropped) AS dropped,
  count(*)::INTEGER AS calls FROM made WHERE NOT over_ GROUP BY doc_id"""
)


def best_judgment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.best_judgment(_attempts(table(spark, sf_dir, "documents")), ["doc_id"])


BEST_JUDGMENT = (
    _ATTEMPTS_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY met DESC, dropped, attempt) AS k,
  count(*) OVER (PARTITION BY doc_id) AS calls FROM made WHERE NOT over_)
SELECT doc_id, attempt, met, dropped, calls::INTEGER AS calls FROM r WHERE k = 1"""
)

QUERIES = {
    "resolve_claims": resolve_claims,
    "resolve_stored": resolve_stored,
    "evidence_stats": evidence_stats,
    "split_outcomes": split_outcomes,
    "flatten_profile": flatten_profile,
    "verified_profile": verified_profile,
    "segments": segments,
    "best_attempt": best_attempt,
    "best_judgment": best_judgment,
}
ORACLES = {
    "resolve_claims": RESOLVE_CLAIMS,
    "resolve_stored": RESOLVE_CLAIMS,
    "evidence_stats": EVIDENCE_STATS,
    "split_outcomes": SPLIT_OUTCOMES,
    "flatten_profile": FLATTEN_PROFILE,
    "verified_profile": VERIFIED_PROFILE,
    "segments": SEGMENTS,
    "best_attempt": BEST_ATTEMPT,
    "best_judgment": BEST_JUDGMENT,
}
