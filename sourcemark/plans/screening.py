"""Registered queries: requirement lines, judging, staleness, ranking, retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcemark.operators import judging as jd
from sourcemark.operators import profiles as pf
from sourcemark.operators import ranking as rk
from sourcemark.operators import retrieval as rt
from sourcemark.operators import sections as sec
from sourcemark.operators.postings import PostingStore
from sourcemark.plans.common import DataFrame, SparkSession, sql_round, table
from sourcemark.session import settle, use_checkpoint_dir

PROMPT = "judge-v1"


def _requirements(passages: DataFrame) -> DataFrame:
    """A job per benchmark passage, asking for each of its words of six letters or more."""
    words = F.array_distinct(
        F.filter(F.split("text", r"[^\p{L}]+", -1), lambda w: F.char_length(w) >= 6)
    )
    return passages.select(F.col("item_id").alias("job_id"), F.posexplode(words).alias("position", "label")).select(
        "job_id",
        "position",
        F.lit(0).alias("created_at"),
        F.concat_ws("-", "job_id", "position").alias("id"),
        "label",
        F.lit("skill").alias("kind"),
        F.when(F.col("position") % 3 == 0, F.concat(F.lit('say "'), "label", F.lit('"/ü'))).alias("detail"),
        (F.col("position") == 0).alias("must_have"),
        F.char_length("label").cast("double").alias("weight"),
    )


_REQ = r"""
WITH w AS (SELECT item_id AS job_id, list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: length(x) >= 6) AS ws FROM benchmark),
v AS (SELECT job_id, unnest(ws) AS label, unnest(range(len(ws))) AS i FROM w),
f AS (SELECT job_id, label, min(i) AS i FROM v GROUP BY ALL),
req AS (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY i) - 1)::INTEGER AS position, label FROM f)
"""


def _pairs(docs: DataFrame, jobs: int) -> DataFrame:
    """Every document is put to one job."""
    return docs.select("doc_id", (F.col("doc_id") % jobs).alias("job_id"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    requirements = _requirements(passages)
    pairs = _pairs(docs, passages.count())
    return docs.select("doc_id", "text"), requirements, pairs


_LINE_HITS = (
    _REQ
    + r""", pr AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS job_id, text FROM documents),
ln AS (SELECT doc_id, job_id, unnest(range(len(string_split(text, chr(10))))) AS n, trim(unnest(string_split(text, chr(10)))) AS line FROM pr),
hit AS (SELECT doc_id, job_id, position, label, arg_min(line, n) AS quote FROM ln JOIN req USING (job_id)
  WHERE line <> '' AND contains(replace(lower(line), 'ß', 'ss'), replace(lower(label), 'ß', 'ss')) GROUP BY ALL)
"""
)


def line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, requirements, pairs = _asked(spark, sf_dir)
    asked = pairs.join(requirements.select("job_id", "position", "label"), "job_id")
    return sec.line_match(asked, docs).select("doc_id", "job_id", "position", "label", "quote")


LINE_MATCH = _LINE_HITS + "SELECT * FROM hit"


def _answers(spark: SparkSession, sf_dir: str):
    """Raw answers: located lines, a repeated number, an invented quote and two unknown numbers."""
    docs, requirements, pairs = _asked(spark, sf_dir)
    asked = pairs.join(requirements.select("job_id", "position", "label"), "job_id")
    hits = sec.line_match(asked, docs)
    match = lambda n, q: F.struct(n.cast("int").alias("requirement"), F.array(q).alias("quotes"))
    found = hits.groupBy("job_id", "doc_id").agg(
        F.array_sort(F.collect_list(match(F.col("position") + 1, F.col("quote")))).alias("_found")
    )
    extra = F.array(
        match(F.lit(0), F.lit("nobody asked")),
        match(F.lit(1), F.lit("zqx invented for the first")),
        match(F.lit(2), F.lit(" ")),
        match(F.lit(999), F.lit("nobody asked either")),
    )
    raw = pairs.join(found, ["job_id", "doc_id"], "left").select(
        "job_id",
        "doc_id",
        F.concat(F.coalesce(F.col("_found"), F.array().cast("array<struct<requirement:int,quotes:array<string>>>")), extra).alias("matches"),
    )
    # Answers are recorded before they are judged.
    return settle(raw), jd.requirement_specs(requirements), docs


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments; two documents in 45 come without text and are refused."""
    raw, specs, docs = _answers(spark, sf_dir)
    rest = F.col("doc_id") % 45
    docs = docs.withColumn("text", F.when(rest == 0, F.lit("")).when(rest != 9, F.col("text")))
    judged = jd.judge(raw, specs, docs, ["job_id", "doc_id"])
    cited = pf.judgment_evidence(judged, judged.columns)
    return cited.select(
        "job_id",
        "doc_id",
        F.array_join(
            F.transform("requirements", lambda r: F.when(r["verdict"] == "met", "1").otherwise("0")), ""
        ).alias("verdicts"),
        F.array_join(F.transform("dropped", lambda d: F.concat(d["field"], F.lit("="), d["reason"])), ",").alias("dropped"),
        "requirements_met",
        "requirements_total",
        "claims_verified",
        "claims_dropped",
        "hallucination_rate",
        F.size("refs").cast("bigint").alias("refs"),
        "refusal",
    )


JUDGE = (
    _LINE_HITS
    + rf""", g AS (SELECT pr.doc_id, pr.job_id, req.position, hit.quote FROM pr JOIN req USING (job_id) LEFT JOIN hit USING (doc_id, job_id, position)),
j AS (SELECT job_id, doc_id, string_agg(CASE WHEN length(quote) >= 4 THEN '1' ELSE '0' END, '' ORDER BY position) AS verdicts,
  coalesce(string_agg('requirements[' || position || ']=too_short', ',' ORDER BY position) FILTER (length(quote) < 4 AND position > 1), '') AS short_,
  count(*) FILTER (length(quote) < 4) AS shorts,
  count(*) FILTER (length(quote) >= 4) AS claims_verified, count(*)::INTEGER AS requirements_total FROM g GROUP BY ALL),
k AS (SELECT *, (4 + shorts)::BIGINT AS claims_dropped FROM j)
SELECT job_id, doc_id, verdicts, 'matches[requirement=0]=unknown_requirement,matches[requirement=999]=unknown_requirement,requirements[0]=not_found,requirements[1]=empty' || short_ AS dropped,
  claims_verified::INTEGER AS requirements_met, requirements_total, claims_verified, claims_dropped,
  {sql_round("(claims_dropped::DOUBLE / (claims_verified + claims_dropped))", 4)} AS hallucination_rate, claims_verified AS refs, NULL::VARCHAR AS refusal FROM k WHERE doc_id % 45 NOT IN (0, 9)
UNION ALL SELECT job_id, doc_id, '', '', 0, 0, 0, 0, 0.0, 0, 'no_text' FROM pr WHERE doc_id % 45 IN (0, 9)"""
)


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = jd.requirement_specs(_requirements(table(spark, sf_dir, "benchmark")))
    return specs.select("job_id", jd.fingerprint(F.col("specs")).alias("fingerprint"))


FINGERPRINT = (
    _REQ
    + r"""SELECT job_id, sha256('[' || string_agg('["skill","' || label || '","' ||
  CASE WHEN position % 3 = 0 THEN 'say \"' || label || '\"/ü' ELSE '' END || '"]', ',' ORDER BY position) || ']') AS fingerprint
FROM req GROUP BY job_id"""
)

# Orders as screenings: the customer's job, the order's status and priority as their state.
_JOBS = 50
_SCREENING_SQL = """
s AS (SELECT o_orderkey AS screening_id, o_custkey % 50 AS job_id, o_custkey AS resume_id,
  CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'old' WHEN '2-HIGH' THEN NULL ELSE 'now' END AS hash,
  CASE WHEN o_orderkey % 11 = 0 THEN 'judge-v0' ELSE 'judge-v1' END AS prompt FROM orders)
"""


def _screenings(orders: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "P", "processing")
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "failed")
        .otherwise("completed")
    )
    stored = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "old")
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(None))
        .otherwise("now")
    )
    return orders.select(
        F.col("o_orderkey").alias("screening_id"),
        (F.col("o_custkey") % _JOBS).alias("job_id"),
        F.col("o_custkey").alias("resume_id"),
        status.alias("status"),
        stored.alias("requirements_hash"),
        F.when(F.col("o_orderkey") % 11 == 0, "judge-v0").otherwise(PROMPT).alias("prompt_version"),
    )


def _current(orders: DataFrame) -> DataFrame:
    return orders.select((F.col("o_custkey") % _JOBS).alias("job_id")).distinct().withColumn(
        "current_hash", F.lit("now")
    )


def stale_screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return jd.stale_screenings(_screenings(orders), _current(orders), PROMPT).select("screening_id", "job_id", "is_stale")


STALE_SCREENINGS = f"""WITH {_SCREENING_SQL} SELECT screening_id, job_id,
  status = 'completed' AND (hash IS DISTINCT FROM 'now' OR prompt IS DISTINCT FROM 'judge-v1') AS is_stale FROM s"""


def pairs_to_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is asked about twice: for their own job and for the next one."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    latest = F.max_by(F.struct("screening_id", "status", "requirements_hash", "prompt_version"), "screening_id")
    screenings = (
        _screenings(orders).groupBy("job_id", "resume_id").agg(latest.alias("_s")).select("job_id", "resume_id", "_s.*")
    )
    pairs = customers.select(
        F.col("c_custkey").alias("resume_id"),
        F.explode(F.array(F.col("c_custkey") % _JOBS, (F.col("c_custkey") + 1) % _JOBS)).alias("job_id"),
        F.col("c_nationkey").alias("_nation"),
    )
    force = F.col("_nation") == 3
    return jd.pairs_to_screen(pairs, screenings, _current(orders), PROMPT, force).drop("_nation")


PAIRS_TO_SCREEN = f"""WITH {_SCREENING_SQL},
l AS (SELECT job_id, resume_id, max(screening_id) AS screening_id FROM s GROUP BY ALL),
k AS (SELECT s.* FROM s JOIN l USING (screening_id)),
p AS (SELECT c_custkey AS resume_id, c_custkey % 50 AS job_id, c_nationkey FROM customer
  UNION ALL SELECT c_custkey, (c_custkey + 1) % 50, c_nationkey FROM customer),
d AS (SELECT p.job_id, p.resume_id, CASE WHEN status IS NULL THEN 'run_new' WHEN c_nationkey = 3 THEN 'forced' WHEN status = 'processing' THEN 'held'
  WHEN status = 'completed' AND (hash IS DISTINCT FROM 'now' OR prompt <> 'judge-v1') THEN 'stale'
  WHEN status = 'completed' THEN 'current' ELSE 'run' END AS decision FROM p LEFT JOIN k ON p.job_id = k.job_id AND p.resume_id = k.resume_id)
SELECT *, decision NOT IN ('held', 'current') AS queued FROM d"""


def edit_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements of their brand's job; some edits touch weights only."""
    parts, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    job = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    old = parts.select(
        job.alias("job_id"), F.col("p_partkey").alias("id"), F.lit("skill").alias("kind"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("detail")
    )
    new = old.withColumn("label", F.when((F.col("job_id") % 2 == 0) & (F.col("id") % 10 == 0), F.upper("label")).otherwise(F.col("label")))
    return jd.edit_impact(old, new, _screenings(orders))


EDIT_IMPACT = f"""WITH {_SCREENING_SQL},
o AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS job_id, p_partkey, p_name FROM part),
t AS (SELECT job_id, bool_or(job_id % 2 = 0 AND p_partkey % 10 = 0 AND upper(p_name) <> p_name) AS stalening FROM o GROUP BY job_id),
c AS (SELECT job_id, count(*) FILTER (status = 'completed') AS n FROM s GROUP BY job_id)
SELECT job_id, stalening, CASE WHEN stalening THEN coalesce(n, 0) ELSE 0 END::BIGINT AS invalidated FROM t LEFT JOIN c USING (job_id)"""


def _no_citations(line) -> Column:
    return F.array().cast("array<string>")


def _citations(line) -> Column:
    """What a line cites if it proves something: its own words and where they stand."""
    quote = F.concat(F.lit("part "), line["l_partkey"].cast("string"))
    start = (line["l_suppkey"] * 10).cast("int")
    span = F.struct(
        quote.alias("quote"),
        start.alias("char_start"),
        (start + F.char_length(quote)).alias("char_end"),
        line["l_linenumber"].cast("int").alias("page"),
        F.lit("exact").alias("match_kind"),
        F.lit(False).alias("is_ambiguous"),
    )
    return F.filter(F.array(span), lambda _: line["l_returnflag"] != "N")


def _told(cited=_no_citations):
    """A verdict of a line."""
    return lambda line: F.struct(
        F.when(line["l_returnflag"] != "N", "met").otherwise("not_evidenced").alias("verdict"),
        cited(line).alias("evidence"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> dict:
    """Orders as judged screenings of four requirements, lines as their verdicts."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
    specs = F.array(
        *[
            F.struct(
                F.lit(f"r{i}").alias("id"), F.lit(f"q{i}").alias("label"), F.lit("skill").alias("kind"),
                F.lit(None).cast("string").alias("detail"), F.lit(i == 1).alias("must_have"), F.lit(float(i)).alias("weight"),
            )
            for i in range(1, 5)
        ]
    )
    jobs = _current(orders).withColumn("specs", specs)
    resumes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("filename"))
    return {
        "screenings": _screenings(orders),
        "jobs": jobs,
        "resumes": resumes,
        "prompt": PROMPT,
        "verdicts": lines.select(F.col("l_orderkey").alias("screening_id"), *fields),
    }


_JUDGED_SQL = f"""WITH {_SCREENING_SQL},
v AS (SELECT l_orderkey, l_returnflag <> 'N' AS met, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i FROM lineitem),
a AS (SELECT l_orderkey, count(*) AS n, bool_or(met AND i = 1) AS gate, count(*) FILTER (met) AS m,
  coalesce(sum(i) FILTER (met), 0)::DOUBLE / 10.0 AS share FROM v GROUP BY l_orderkey),
r AS (SELECT s.*, c_name AS filename, gate, m, share, CASE WHEN status <> 'completed' THEN 'not_completed'
  WHEN hash IS DISTINCT FROM 'now' OR prompt <> 'judge-v1' THEN 'stale'
  WHEN n IS NULL OR n <> 4 THEN 'malformed' END AS reason
  FROM s JOIN customer ON c_custkey = resume_id LEFT JOIN a ON l_orderkey = screening_id)
"""


def rank_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.ranked(**_judged(spark, sf_dir), judged=_told()).select(
        "job_id", "rank", "screening_id", "filename", "gate_passed", "score", "must_haves_met", "requirements_met", "requirements_total"
    )


RANK_ORDERS = (
    _JUDGED_SQL
    + f""", k AS (SELECT job_id, screening_id, filename, gate AS gate_passed, {sql_round("share", 6)} AS score, gate::INTEGER AS must_haves_met,
  m::INTEGER AS requirements_met, 4 AS requirements_total FROM r WHERE reason IS NULL)
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY gate_passed DESC, score DESC, requirements_met DESC, screening_id) AS rank FROM k"""
)


def ranking_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict behind every rank, with what it cites."""
    ranked = rk.ranked(**_judged(spark, sf_dir), judged=_told(_citations))
    cited = F.get("evidence", F.lit(0))
    return rk.rationale(ranked).select(
        "job_id", "rank", "screening_id", "filename", "position", "requirement_id", "label", "must_have", "weight", "verdict",
        F.size("evidence").alias("citations"), cited["quote"].alias("quote"), cited["char_start"].alias("char_start"),
        cited["char_end"].alias("char_end"), cited["page"].alias("page"),
    )


RANKING_RATIONALE = (
    RANK_ORDERS.replace("SELECT *, row_number()", ", o AS (SELECT *, row_number()", 1)
    + """), c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS i,
  l_returnflag <> 'N' AS met FROM lineitem)
SELECT job_id, rank, screening_id, filename, (i - 1)::INTEGER AS position, 'r' || i AS requirement_id, 'q' || i AS label, i = 1 AS must_have, i::DOUBLE AS weight,
  CASE WHEN met THEN 'met' ELSE 'not_evidenced' END AS verdict, met::INTEGER AS citations, CASE WHEN met THEN 'part ' || l_partkey END AS quote,
  CASE WHEN met THEN (l_suppkey * 10)::INTEGER END AS char_start, CASE WHEN met THEN (l_suppkey * 10 + length('part ' || l_partkey))::INTEGER END AS char_end,
  CASE WHEN met THEN l_linenumber::INTEGER END AS page
FROM o JOIN c ON l_orderkey = screening_id"""
)


def judge_unasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third job asks for nothing: its judgments are empty. The others ask for the first words of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    asks = F.col("job_id") % 3 != 0
    match = F.array(F.struct(F.lit(1).alias("requirement"), F.array(F.substring("text", 1, 30)).alias("quotes")))
    none = "array<struct<requirement:int,quotes:array<string>>>"
    raw = docs.withColumn("job_id", F.col("doc_id") % 10).select(
        "job_id", "doc_id", F.when(asks, match).otherwise(F.array().cast(none)).alias("matches")
    )
    spec = F.struct(
        F.lit("r1").alias("id"), F.lit("opening").alias("label"), F.lit("skill").alias("kind"),
        F.lit(None).cast("string").alias("detail"), F.lit(True).alias("must_have"), F.lit(1.0).alias("weight"),
    )
    specs = spark.range(10).select(F.col("id").alias("job_id")).where(asks).select("job_id", F.array(spec).alias("specs"))
    return jd.judge(settle(raw), specs, docs, ["job_id", "doc_id"]).select(
        "job_id", "doc_id", F.size("requirements").alias("requirements"), "requirements_met", "requirements_total",
        "claims_verified", "claims_dropped", "hallucination_rate", "refusal",
    )


JUDGE_UNASKED = r"""WITH d AS (SELECT doc_id % 10 AS job_id, doc_id, doc_id % 10 % 3 <> 0 AS asks, coalesce(text, '') = '' AS bare,
  length(regexp_replace(substr(text, 1, 30), '^\s+|\s+$', '', 'g')) >= 4 AS long FROM documents),
f AS (SELECT *, (asks AND NOT bare)::INTEGER AS n, (asks AND NOT bare AND long)::INTEGER AS met FROM d)
SELECT job_id, doc_id, n AS requirements, met AS requirements_met, n AS requirements_total, met::BIGINT AS claims_verified, (n - met)::BIGINT AS claims_dropped,
  (n - met)::DOUBLE AS hallucination_rate, CASE WHEN bare THEN 'no_text' END AS refusal FROM f"""


def excluded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.excluded(**_judged(spark, sf_dir))


EXCLUDED_ORDERS = _JUDGED_SQL + "SELECT job_id, screening_id, resume_id, filename, status, reason FROM r WHERE reason IS NOT NULL"


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request whose terms are all benchmark passages, over every document."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_no"), F.col("text").alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rt.retrieve(terms, docs, digits=6).select(
        "doc_id", F.round("score", 6).alias("score"), F.size("matched").alias("matched"), "place"
    )


_TOKENS_SQL = r"""
dt AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2))) AS token FROM documents),
tk AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS ts FROM benchmark),
tt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS token FROM tk)
"""
RETRIEVE = f"""WITH {_TOKENS_SQL},
df AS (SELECT token, count(*) AS df FROM dt GROUP BY token),
p AS (SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) * avg(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + df))) AS part
  FROM dt JOIN tt USING (token) JOIN df USING (token) GROUP BY ALL),
s AS (SELECT doc_id, sum(part) AS score, count(*)::INTEGER AS matched FROM p GROUP BY doc_id),
a AS (SELECT d.doc_id, round(coalesce(score, 0.0), 6) AS score, coalesce(matched, 0) AS matched FROM documents d LEFT JOIN s USING (doc_id))
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM a"""


def retrieve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per owner of a language over postings stored before: most documents first, the others as a delta."""
    use_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("owner_id"), "text")
    store = PostingStore(spark, f"{spark.sparkContext.getCheckpointDir()}/postings-{uuid.uuid4().hex}", ["owner_id"], shards=16).create()
    delta = F.col("doc_id") % 10 == 0
    store.add(docs.where(~delta), 0)
    store.add(docs.where(delta), 1)
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    terms = table(spark, sf_dir, "benchmark").select(
        F.get(langs, (F.col("item_id") % 4).cast("int")).alias("owner_id"), F.col("item_id").alias("term_no"), F.col("text").alias("term")
    )
    return store.retrieve(terms, digits=6).select(
        "owner_id", "doc_id", F.round("score", 6).alias("score"), F.sha2(F.array_join("matched", "\n"), 256).alias("matched_sha256"), "place"
    )


RETRIEVE_STORED = r"""WITH
dt AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2))) AS token FROM documents),
tm AS (SELECT ['en','de','fr','es'][(item_id % 4 + 1)::INTEGER] AS lang, item_id, text AS term FROM benchmark),
tk AS (SELECT *, list_distinct(list_filter(regexp_extract_all(replace(lower(term), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS ts FROM tm),
tt AS (SELECT lang, item_id, term, len(ts) AS n, unnest(ts) AS token FROM tk),
df AS (SELECT lang, token, count(*) AS df FROM dt GROUP BY ALL),
nn AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang),
p AS (SELECT doc_id, item_id, any_value(term) AS term, count(*)::DOUBLE / any_value(n) * avg(ln(1 + total::DOUBLE / (1 + df))) AS part
  FROM dt JOIN tt USING (lang, token) JOIN df USING (lang, token) JOIN nn USING (lang) GROUP BY ALL),
s AS (SELECT doc_id, sum(part) AS score, string_agg(term, chr(10) ORDER BY item_id) AS matched FROM p GROUP BY doc_id),
a AS (SELECT lang AS owner_id, d.doc_id, round(coalesce(score, 0.0), 6) AS score, sha256(coalesce(matched, '')) AS matched_sha256 FROM documents d LEFT JOIN s USING (doc_id))
SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, doc_id) AS place FROM a"""


def suggest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per language, asked by the owner of all documents in that language."""
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    resumes = docs.select(
        F.col("doc_id").alias("resume_id"), F.col("lang").alias("owner_id"), "text", F.concat(F.lit("cv"), "doc_id").alias("filename")
    )
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    requests = resumes.select("owner_id").distinct().select(
        "owner_id", (F.array_position(langs, F.col("owner_id")) - 1).alias("job_id")
    )
    requirements = passages.select(
        (F.col("item_id") % 4).alias("job_id"),
        F.col("item_id").cast("int").alias("position"),
        F.col("text").alias("label"),
        F.when(F.col("item_id") % 5 == 0, "the of").alias("detail"),
    )
    screenings = resumes.where(F.col("resume_id") % 7 == 0).select("resume_id", F.lit(0).cast("bigint").alias("job_id"))
    out = rt.suggest_candidates(requests, requirements, resumes, screenings)
    return out.select("job_id", "owner_id", "resume_id", "filename", "score", F.size("matched").alias("matched"), "already_screened", "place")


SUGGEST_CANDIDATES = (
    r"""WITH
dt AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2))) AS token FROM documents),
tm AS (SELECT ['en','de','fr','es'][(item_id % 4 + 1)::INTEGER] AS lang, item_id * 2 AS term_no, text AS term FROM benchmark
  UNION ALL SELECT ['en','de','fr','es'][(item_id % 4 + 1)::INTEGER], item_id * 2 + 1, 'the of' FROM benchmark WHERE item_id % 5 = 0),
tk AS (SELECT lang, term_no, list_distinct(list_filter(regexp_extract_all(replace(lower(term), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS ts FROM tm),
tt AS (SELECT lang, term_no, len(ts) AS n, unnest(ts) AS token FROM tk),
df AS (SELECT lang, token, count(*) AS df FROM dt GROUP BY ALL),
nn AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang),
p AS (SELECT lang, doc_id, term_no, count(*)::DOUBLE / any_value(n) * avg(ln(1 + total::DOUBLE / (1 + df))) AS part
  FROM dt JOIN tt USING (lang, token) JOIN df USING (lang, token) JOIN nn USING (lang) GROUP BY ALL),
s AS (SELECT doc_id, sum(part) AS score, count(*)::INTEGER AS matched FROM p GROUP BY doc_id),
a AS (SELECT d.doc_id, lang, coalesce(score, 0.0) AS raw, coalesce(matched, 0) AS matched FROM documents d LEFT JOIN s USING (doc_id))
SELECT (list_position(['en','de','fr','es'], lang) - 1)::BIGINT AS job_id, lang AS owner_id, doc_id AS resume_id, 'cv' || doc_id AS filename,
  """
    + sql_round("raw", 4)
    + """ AS score, matched, doc_id % 7 = 0 AND lang = 'en' AS already_screened,
  row_number() OVER (PARTITION BY lang ORDER BY round(raw, 9) DESC, doc_id) AS place FROM a"""
)


def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.retrieval_terms(_requirements(table(spark, sf_dir, "benchmark")))


RETRIEVAL_TERMS = (
    _REQ
    + """SELECT job_id, position * 2 AS term_no, label AS term FROM req
UNION ALL SELECT job_id, position * 2 + 1, 'say "' || label || '"/ü' FROM req WHERE position % 3 = 0"""
)


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.doc_freq(rt.postings(table(spark, sf_dir, "documents")))


DOC_FREQ = f"WITH {_TOKENS_SQL} SELECT token, count(*) AS df FROM dt GROUP BY token"

QUERIES = {
    "line_match": line_match,
    "judge": judge,
    "fingerprint": fingerprint,
    "stale_screenings": stale_screenings,
    "pairs_to_screen": pairs_to_screen,
    "edit_impact": edit_impact,
    "rank_orders": rank_orders,
    "ranking_rationale": ranking_rationale,
    "judge_unasked": judge_unasked,
    "excluded_orders": excluded_orders,
    "retrieve": retrieve,
    "retrieve_stored": retrieve_stored,
    "suggest_candidates": suggest_candidates,
    "retrieval_terms": retrieval_terms,
    "doc_freq": doc_freq,
}
ORACLES = {
    "line_match": LINE_MATCH,
    "judge": JUDGE,
    "fingerprint": FINGERPRINT,
    "stale_screenings": STALE_SCREENINGS,
    "pairs_to_screen": PAIRS_TO_SCREEN,
    "edit_impact": EDIT_IMPACT,
    "rank_orders": RANK_ORDERS,
    "ranking_rationale": RANKING_RATIONALE,
    "judge_unasked": JUDGE_UNASKED,
    "excluded_orders": EXCLUDED_ORDERS,
    "retrieve": RETRIEVE,
    "retrieve_stored": RETRIEVE_STORED,
    "suggest_candidates": SUGGEST_CANDIDATES,
    "retrieval_terms": RETRIEVAL_TERMS,
    "doc_freq": DOC_FREQ,
}
