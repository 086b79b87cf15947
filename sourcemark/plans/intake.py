"""Registered queries: admission, duplicates, retention, privacy, and tracking of work."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sourcemark.operators import ingest as ig
from sourcemark.operators import privacy as pv
from sourcemark.operators import worktrack as wt
from sourcemark.operators.ordered import number_within
from sourcemark.plans.common import DataFrame, SparkSession, table
from sourcemark.session import settle, use_checkpoint_dir
from sourcemark.sources import erasure as er
from sourcemark.sources import keyed
from sourcemark.sources.tables import outside_vocabulary

# Magic bytes for the test files: web pages stand in for the first type.
_MAGIC = {".html": "3C21444F43545950", ".pdf": "255044462D", ".docx": "504B0304"}


def admit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads under five kinds of names; some are empty, too large or mislabelled."""
    n = F.col("page_id")
    names = F.array(*[F.lit(s) for s in (".html", ".HTML", ".pdf", "", ".txt")])
    content = F.when(n % 13 == 0, "").when(n % 11 == 0, F.concat(F.lit("x"), "html")).otherwise(F.col("html"))
    files = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("dir.d/page"), F.get(names, (n % 5).cast("int"))).alias("path"),
        F.encode(content, "UTF-8").alias("content"),
        (n % 9 != 0).alias("consent"),
    )
    sized = files.withColumn("length", F.octet_length("content").cast("bigint"))
    return ig.admit(sized, _MAGIC, 3000).select("page_id", "suffix", "length", "reason")


ADMIT_PAGES = """
WITH f AS (SELECT page_id, ['.html','.html','.pdf','.d/page','.txt'][(page_id % 5 + 1)::INTEGER] AS suffix,
  CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'x' || html ELSE html END AS content FROM pages)
SELECT page_id, suffix, strlen(content)::BIGINT AS length, CASE WHEN page_id % 9 = 0 THEN 'no_consent' WHEN suffix NOT IN ('.html', '.pdf', '.docx') THEN 'unsupported_type'
  WHEN content = '' THEN 'empty' WHEN strlen(content) > 3000 THEN 'too_large' WHEN suffix = '.html' AND starts_with(content, '<!DOCTYP') THEN NULL
  WHEN suffix = '.pdf' AND starts_with(content, '%PDF-') THEN NULL ELSE 'magic_mismatch' END AS reason FROM f"""


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored files, admitted by their leading bytes and named by content hash."""
    found = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("store/"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"),
        F.lit(True).alias("consent"),
    )
    admitted = ig.admit(found.withColumn("length", F.octet_length("content").cast("bigint")), _MAGIC, 1 << 30)
    return admitted.select("path", "length", ig.content_hash(F.col("content")).alias("content_hash"), "reason")


STORED_FILES = """
SELECT 'store/' || page_id || '.html' AS path, strlen(coalesce(html, ''))::BIGINT AS length, sha256(coalesce(html, '')) AS content_hash,
  CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN NOT starts_with(html, '<!DOCTYP') THEN 'magic_mismatch' END AS reason FROM pages"""


def files_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored files under their key, then every third one asked for by key, and some that are not there."""
    use_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    n = F.col("page_id")
    key = F.concat((n % 100).cast("string"), F.lit("/"), n.cast("string"), F.lit(".html"))
    pages = table(spark, sf_dir, "pages").select("page_id", key.alias("storage_key"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    written = settle(keyed.store_files(pages, root))
    third = F.regexp_extract("storage_key", r"(\d+)\.html", 1).cast("bigint") % 3 == 0
    asked = written.where(third).union(written.where(third).select(F.concat("storage_key", F.lit(".gone"))))
    return keyed.read_by_key(spark, root, asked).select("storage_key", "length", ig.content_hash(F.col("content")).alias("content_hash"))


FILES_BY_KEY = """
WITH p AS (SELECT (page_id % 100) || '/' || page_id || '.html' AS storage_key, coalesce(html, '') AS h FROM pages WHERE page_id % 3 = 0)
SELECT storage_key, strlen(h)::BIGINT AS length, sha256(h) AS content_hash FROM p UNION ALL SELECT storage_key || '.gone', NULL, NULL FROM p"""


def vocabulary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose status is outside the closed vocabulary."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "extracted").otherwise(
        F.lower("o_orderpriority")
    )
    return outside_vocabulary(orders.select("o_orderkey", status.alias("status")), "status", "resume_status")


VOCABULARY_CHECK = "SELECT o_orderkey, lower(o_orderpriority) AS status FROM orders WHERE o_orderstatus NOT IN ('P', 'F')"


def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents uploaded by the owner of their language; every tenth text is stored already."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"), F.col("lang").alias("owner_id"), ig.content_hash(F.encode("text", "UTF-8")).alias("content_hash")
    )
    stored = docs.where(F.col("upload_id") % 10 == 0).groupBy("owner_id", "content_hash").agg((-F.min("upload_id") - 1).alias("upload_id"))
    kept, answered = ig.dedupe_uploads(docs, stored, ["upload_id"])
    return kept.select("upload_id", "owner_id", F.col("upload_id").alias("kept_id")).unionByName(
        answered.select("upload_id", "owner_id", "kept_id")
    )


DEDUPE_DOCUMENTS = """
WITH d AS (SELECT doc_id AS upload_id, lang AS owner_id, sha256(text) AS h FROM documents),
s AS (SELECT owner_id, h, -min(upload_id) - 1 AS old FROM d WHERE upload_id % 10 = 0 GROUP BY ALL)
SELECT upload_id, owner_id, coalesce(old, min(upload_id) OVER (PARTITION BY owner_id, h)) AS kept_id FROM d LEFT JOIN s USING (owner_id, h)"""


def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("expires_at")
    )
    kept, gone = ig.purge_expired(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return kept.withColumn("expired", F.lit(False)).unionByName(gone.withColumn("expired", F.lit(True))).select("event_id", "expired")


PURGE_EXPIRED = """SELECT event_id, event_id % 50 <> 0 AND ts < TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events"""


def check_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements of their brand: some blank, overlong, weightless or beyond the limit."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("job_id"),
        n.alias("id"),
        (n % 100).alias("position"),
        F.when(n % 17 == 0, " \t ").when(n % 19 == 0, F.repeat("p_name", 60)).otherwise(F.col("p_name")).alias("label"),
        F.repeat(F.lit("x"), F.col("p_size") * 45).alias("detail"),
        (F.col("p_size") * 3 - 9).cast("double").alias("weight"),
    )
    return ig.check_requirements(rows).select("id", "job_id", "nth", "reason")


CHECK_REQUIREMENTS = """
WITH r AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS job_id, p_partkey AS id, p_partkey % 100 AS position,
  CASE WHEN p_partkey % 17 = 0 THEN ' ' WHEN p_partkey % 19 = 0 THEN repeat(p_name, 60) ELSE p_name END AS label, p_size * 45 AS d, p_size * 3 - 9 AS w FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, trim(label) = '' ORDER BY position, id) AS k FROM r)
SELECT id, job_id, CASE WHEN trim(label) <> '' THEN k END AS nth, CASE WHEN trim(label) = '' THEN 'blank_label' WHEN length(label) > 300 THEN 'label_too_long'
  WHEN d > 2000 THEN 'detail_too_long' WHEN w <= 0 OR w > 100 THEN 'bad_weight' WHEN k > 30 THEN 'too_many' END AS reason FROM n"""


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The driver's tables seen as entity tables; the accounts of one nation ask."""
    c = F.col
    day = lambda n: F.make_timestamp_ntz(F.lit(2024), F.lit(1), (n % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    null = lambda kind: F.lit(None).cast(kind)
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    tables = {
        "accounts": customers.select(
            c("c_custkey").alias("account_id"), F.lower("c_name").alias("email"), c("c_name").alias("display_name"),
            F.lit("candidate").alias("role"), day(c("c_custkey")).alias("created_at"),
        ),
        "resumes": customers.select(
            (c("c_custkey") + 1_000_000).alias("resume_id"), F.floor(c("c_custkey") / 2).alias("owner_id"), c("c_name").alias("filename"),
            c("c_nationkey").alias("size_bytes"), F.sha2("c_name", 256).alias("content_hash"), F.lit("extracted").alias("status"),
            day(c("c_custkey")).alias("created_at"), null("timestamp_ntz").alias("consented_at"), null("string").alias("consent_version"),
            F.lit(1).alias("page_count"), F.array().cast("array<int>").alias("pages_from_ocr"), c("c_mktsegment").alias("text"),
            F.concat(F.lit("key/"), "c_name").alias("storage_key"),
        ),
        "jobs": table(spark, sf_dir, "supplier").select(
            (c("s_suppkey") + 2_000_000).alias("job_id"), c("s_suppkey").alias("owner_id"), c("s_name").alias("title"),
            null("string").alias("description"), day(c("s_suppkey")).alias("created_at"),
        ),
        "profiles": customers.where(c("c_custkey") % 3 == 0).select(
            (c("c_custkey") + 1_000_000).alias("resume_id"), F.struct(c("c_name").alias("full_name")).alias("profile")
        ),
        "requirements": table(spark, sf_dir, "part").select(
            (c("p_partkey") % 100 + 2_000_000).alias("job_id"), c("p_partkey").alias("position"), F.lit("skill").alias("kind"),
            c("p_name").alias("label"), null("string").alias("detail"), (c("p_size") > 25).alias("must_have"), c("p_retailprice").alias("weight"),
        ),
        "screenings": orders.select(
            (c("o_orderkey") + 3_000_000).alias("screening_id"), (c("o_orderkey") % 100 + 2_000_000).alias("job_id"),
            (c("o_custkey") + 1_000_000).alias("resume_id"), F.lit("completed").alias("status"), F.lit(1).alias("requirements_met"),
            F.lit(2).alias("requirements_total"), c("o_orderdate").alias("created_at"),
        ),
        "applications": orders.select(
            (c("o_orderkey") + 4_000_000).alias("application_id"), (c("o_orderkey") % 100 + 2_000_000).alias("job_id"),
            F.floor(c("o_custkey") / 2).alias("candidate_id"), (c("o_custkey") + 1_000_000).alias("resume_id"), F.lit("applied").alias("state"),
            c("o_orderdate").alias("created_at"),
        ),
        "events": table(spark, sf_dir, "lineitem").select(
            (c("l_orderkey") + 4_000_000).alias("application_id"), c("l_linenumber").alias("position"), null("string").alias("from_state"),
            F.lit("applied").alias("to_state"), F.when(c("l_returnflag") != "N", c("l_suppkey")).alias("actor_id"), null("string").alias("reason"),
            F.when(c("l_returnflag") == "R", c("l_orderkey") + 3_000_000).alias("screening_id"), c("l_shipdate").alias("created_at"),
        ),
        "calls": table(spark, sf_dir, "events").select(
            c("event_id").alias("call_id"), F.when(c("event_id") % 3 == 0, c("user_id") + 1_000_000).alias("resume_id"),
            F.when(c("event_id") % 3 == 1, c("event_id") + 3_000_000).alias("screening_id"), F.lit("p").alias("provider"), c("event_type").alias("model"),
            F.lit("v1").alias("prompt_version"), c("user_id").alias("input_tokens"), c("user_id").alias("output_tokens"), c("value").alias("cost_usd"),
            c("ts").alias("created_at"),
        ),
    }
    asking = customers.where(c("c_nationkey") == 3).select(c("c_custkey").alias("account_id"))
    return tables, asking


_ASKING = "asking AS (SELECT c_custkey AS account_id FROM customer WHERE c_nationkey = 3)"


def export_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, asking = _accounts(spark, sf_dir)
    out = pv.export_accounts(tables, asking)
    field = lambda name: F.get_json_object("item", f"$.{name}")
    return out.groupBy("account_id", "section").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(field("by_you") == "true").alias("by_you"),
        F.count_if(field("by_the_system") == "true").alias("by_the_system"),
        F.count_if(field("profile.full_name").isNotNull()).alias("profiles"),
        F.sum(F.coalesce(F.json_array_length(field("requirements")), F.lit(0))).cast("bigint").alias("requirements"),
    )


EXPORT_ACCOUNTS = f"""WITH {_ASKING},
j AS (SELECT s_suppkey AS account_id, s_suppkey AS job_no FROM supplier JOIN asking ON account_id = s_suppkey),
a AS (SELECT o_orderkey, o_custkey // 2 AS account_id FROM orders WHERE o_custkey // 2 IN (FROM asking)),
x AS (SELECT account_id, 'account' AS section, 0 AS y, 0 AS s, 0 AS p, 0 AS q FROM asking
  UNION ALL SELECT c_custkey // 2, 'resumes', 0, 0, (c_custkey % 3 = 0)::INT, 0 FROM customer WHERE c_custkey // 2 IN (FROM asking)
  UNION ALL SELECT account_id, 'jobs', 0, 0, 0, (SELECT count(*) FROM part WHERE p_partkey % 100 = job_no) FROM j
  UNION ALL SELECT account_id, 'applications', 0, 0, 0, 0 FROM a
  UNION ALL SELECT account_id, 'application_events', (l_returnflag <> 'N' AND l_suppkey = account_id)::INT, (l_returnflag = 'N')::INT, 0, 0 FROM lineitem JOIN a ON l_orderkey = o_orderkey
  UNION ALL SELECT o_custkey // 2, 'screenings', 0, 0, 0, 0 FROM orders WHERE o_custkey // 2 IN (FROM asking)
  UNION ALL SELECT user_id // 2, 'model_calls', 0, 0, 0, 0 FROM events WHERE event_id % 3 = 0 AND user_id // 2 IN (FROM asking) AND user_id IN (SELECT c_custkey FROM customer))
SELECT account_id, section, count(*) AS items, sum(y)::BIGINT AS by_you, sum(s)::BIGINT AS by_the_system, sum(p)::BIGINT AS profiles, sum(q)::BIGINT AS requirements FROM x GROUP BY ALL"""


def erase_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of every table after the accounts of one nation are erased."""
    return _survivors(pv.erase_accounts(*_accounts(spark, sf_dir)))


def erase_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored tables, read back after the accounts' files and rows are gone."""
    use_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/erased-{uuid.uuid4().hex}"
    tables, asking = _accounts(spark, sf_dir)
    er.store_tables(tables, f"{root}/tables", 4)
    files = tables["resumes"].select("storage_key", F.encode("filename", "UTF-8").alias("content"))
    before = settle(keyed.store_files(files, f"{root}/files"))
    schemas = {name: ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) for name, rows in tables.items()}
    er.erase_stored(er.read_tables(spark, f"{root}/tables", schemas), asking, f"{root}/tables", f"{root}/files")
    left = er.read_tables(spark, f"{root}/tables", schemas)
    gone = keyed.read_by_key(spark, f"{root}/files", before, opened=False).where(F.col("length").isNull())
    return _survivors({**left, "storage_keys": gone})


def _survivors(left: dict[str, DataFrame]) -> DataFrame:
    key = {**pv.KEY_OF, "profiles": "resume_id", "requirements": "position", "events": "position", "calls": "call_id"}
    parts = []
    for name, rows in left.items():
        count = lambda column: F.count(column) if column in rows.columns else F.lit(0).cast("bigint")
        number = F.sum(key[name]).cast("bigint") if name in key else F.count("storage_key")
        parts.append(
            rows.agg(
                F.lit(name).alias("table"),
                F.count(F.lit(1)).alias("rows"),
                F.coalesce(number, F.lit(0)).alias("keys"),
                (count("actor_id") if name == "events" else F.lit(0).cast("bigint")).alias("actors"),
                (count("screening_id") if name == "events" else F.lit(0).cast("bigint")).alias("screenings"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ERASE_ACCOUNTS = f"""WITH {_ASKING},
gj AS (SELECT s_suppkey AS j FROM supplier WHERE s_suppkey IN (FROM asking)),
gr AS (SELECT c_custkey AS r FROM customer WHERE c_custkey // 2 IN (FROM asking)),
gs AS (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 100 IN (FROM gj) OR o_custkey IN (FROM gr)),
ga AS (SELECT o_orderkey AS a FROM orders WHERE o_orderkey % 100 IN (FROM gj) OR o_custkey IN (FROM gr) OR o_custkey // 2 IN (FROM asking)),
e AS (SELECT l_linenumber, CASE WHEN l_returnflag <> 'N' AND l_suppkey NOT IN (FROM asking) THEN l_suppkey END AS actor,
  CASE WHEN l_returnflag = 'R' AND l_orderkey NOT IN (FROM gs) THEN l_orderkey END AS scr FROM lineitem WHERE l_orderkey NOT IN (FROM ga))
SELECT 'accounts' AS "table", count(*) AS rows, sum(c_custkey)::BIGINT AS keys, 0::BIGINT AS actors, 0::BIGINT AS screenings FROM customer WHERE c_custkey NOT IN (FROM asking)
UNION ALL SELECT 'resumes', count(*), sum(c_custkey + 1000000)::BIGINT, 0, 0 FROM customer WHERE c_custkey NOT IN (FROM gr)
UNION ALL SELECT 'jobs', count(*), sum(s_suppkey + 2000000)::BIGINT, 0, 0 FROM supplier WHERE s_suppkey NOT IN (FROM gj)
UNION ALL SELECT 'profiles', count(*), sum(c_custkey + 1000000)::BIGINT, 0, 0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (FROM gr)
UNION ALL SELECT 'requirements', count(*), sum(p_partkey)::BIGINT, 0, 0 FROM part WHERE p_partkey % 100 NOT IN (FROM gj)
UNION ALL SELECT 'screenings', count(*), sum(o_orderkey + 3000000)::BIGINT, 0, 0 FROM orders WHERE o_orderkey NOT IN (FROM gs)
UNION ALL SELECT 'applications', count(*), sum(o_orderkey + 4000000)::BIGINT, 0, 0 FROM orders WHERE o_orderkey NOT IN (FROM ga)
UNION ALL SELECT 'calls', count(*), sum(event_id)::BIGINT, 0, 0 FROM events WHERE NOT (event_id % 3 = 0 AND user_id IN (FROM gr)) AND NOT (event_id % 3 = 1 AND event_id IN (FROM gs))
UNION ALL SELECT 'events', count(*), sum(l_linenumber)::BIGINT, count(actor), count(scr) FROM e
UNION ALL SELECT 'storage_keys', count(*), count(*), 0, 0 FROM gr"""

_ERRORS = ("LLMUnavailableError", "CorruptDocumentError", "RuntimeError", "LLMConfigError", "WorkerVanished")
_NOW = "2024-01-15 00:00:00"


def _work(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    return events.select(
        e.alias("id"),
        pick(_ERRORS, e % 5).alias("error_class"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("message"),
        (F.floor(e / 5) % 5).alias("failed_attempts"),
        pick(("pending", "processing", "parsed", "extracted", "failed", "dead_lettered"), e % 6).alias("status"),
        F.when(e % 23 != 0, F.col("ts")).alias("last_attempt_at"),
    )


_WORK_SQL = """w AS (SELECT event_id AS id, ['LLMUnavailableError','CorruptDocumentError','RuntimeError','LLMConfigError','WorkerVanished'][(event_id % 5 + 1)::INTEGER] AS error_class,
  'm' || user_id AS message, event_id // 5 % 5 AS failed_attempts, ['pending','processing','parsed','extracted','failed','dead_lettered'][(event_id % 6 + 1)::INTEGER] AS status,
  CASE WHEN event_id % 23 <> 0 THEN ts END AS last_attempt_at FROM events),
k AS (SELECT *, status = 'processing' AND (last_attempt_at IS NULL OR last_attempt_at <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 900 SECOND) AS stalled FROM w)"""


def decide_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wt.decide_retry(_work(table(spark, sf_dir, "events"))).select("id", "verdict", "retry_after_seconds", "reason")


DECIDE_RETRY = f"""WITH {_WORK_SQL}, d AS (SELECT *, CASE WHEN error_class = 'RuntimeError' THEN error_class ELSE error_class || ': ' || message END AS said,
  CASE WHEN error_class IN ('CorruptDocumentError', 'LLMConfigError') THEN 'permanent' WHEN failed_attempts >= 3 THEN 'exhausted' ELSE 'retry' END AS verdict FROM w)
SELECT id, verdict, CASE WHEN verdict = 'retry' THEN 5.0::DOUBLE * pow(2, greatest(failed_attempts - 1, 0)) END AS retry_after_seconds,
  CASE verdict WHEN 'permanent' THEN said WHEN 'exhausted' THEN 'Gave up after ' || failed_attempts || ' attempts. Last error — ' || said
    ELSE 'Attempt ' || failed_attempts || ' failed, retrying — ' || said END AS reason FROM d"""


def reclaim_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    return wt.reclaim_stalled(_work(table(spark, sf_dir, "events")), now).select("id", "failed_attempts", "status", "verdict", "retry_after_seconds")


RECLAIM_STALLED = f"""WITH {_WORK_SQL} SELECT id, failed_attempts + 1 AS failed_attempts, CASE WHEN failed_attempts + 1 >= 3 THEN 'dead_lettered' ELSE 'pending' END AS status,
  CASE WHEN failed_attempts + 1 >= 3 THEN 'exhausted' ELSE 'retry' END AS verdict, CASE WHEN failed_attempts + 1 < 3 THEN 5.0::DOUBLE * pow(2, failed_attempts) END AS retry_after_seconds FROM k WHERE stalled"""


def retryable_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    of = lambda statuses: wt.retryable(F.col("status"), F.col("last_attempt_at"), now, statuses)
    return _work(table(spark, sf_dir, "events")).select(
        "id", of(wt.RESUME_RETRYABLE).alias("resume_retryable"), of(wt.SCREENING_RETRYABLE).alias("screening_retryable")
    )


RETRYABLE_WORK = f"""WITH {_WORK_SQL} SELECT id, status IN ('dead_lettered', 'failed', 'parsed') OR stalled AS resume_retryable, status IN ('dead_lettered', 'failed') OR stalled AS screening_retryable FROM k"""

# Readings come a few thousand times faster than the events they are taken from.
_SPEED = 5000
_EPOCH = 1704067200000000


def reading_rows(events: DataFrame) -> DataFrame:
    """A user's events as readings of one row's status: id, at, event_id, status, payload."""
    kind, e = F.col("event_type"), F.col("event_id")
    status = (
        F.when((kind == "signup") & (e % 50 == 0), F.lit(None))
        .when((kind == "error") & (e % 20 == 0), "failed")
        .when(kind == "view", "pending")
        .otherwise("processing")
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH
    return events.select(
        F.col("user_id").alias("id"),
        F.timestamp_micros((F.lit(_EPOCH) + F.floor(micros / _SPEED)).cast("bigint")).alias("at"),
        "event_id",
        status.alias("status"),
        F.concat(kind, (e % 2).cast("string")).alias("payload"),
    )


def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading_rows(table(spark, sf_dir, "events"))
    numbered = number_within(rows, ["id"], [F.col("at"), F.col("event_id")], "seq", start=0)
    return wt.status_feed(numbered).select("id", "seq", "payload", "frame")


STATUS_FEED = """
WITH r AS (SELECT user_id AS id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 5000 AS read_at, event_id, event_type || (event_id % 2) AS payload,
  CASE WHEN event_type = 'signup' AND event_id % 50 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'failed' WHEN event_type = 'view' THEN 'pending' ELSE 'processing' END AS status FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY read_at, event_id) - 1 AS seq, min(read_at) OVER (PARTITION BY id) AS began FROM r),
c AS (SELECT *, CASE WHEN status IS NULL THEN 'gone' WHEN status = 'failed' THEN 'done' WHEN read_at >= began + 300000000 THEN 'timeout' END AS closing FROM s),
l AS (SELECT *, min(seq) FILTER (closing IS NOT NULL) OVER (PARTITION BY id) AS stop FROM c),
k AS (SELECT *, lag(payload) OVER (PARTITION BY id ORDER BY seq) AS before FROM l WHERE stop IS NULL OR seq <= stop)
SELECT id, seq, payload, 'status' AS frame FROM k WHERE status IS NOT NULL AND payload IS DISTINCT FROM before
UNION ALL SELECT id, seq, payload, closing FROM k WHERE closing IS NOT NULL"""


def dedupe_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    dispatches = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("attempt"), F.col("ts").alias("at"), "event_id"
    )
    return wt.dedupe_dispatch(dispatches)


DEDUPE_DISPATCH = """SELECT user_id AS id, event_id % 3 AS attempt, min(ts) AS at, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL"""

QUERIES = {
    "admit_pages": admit_pages,
    "stored_files": stored_files,
    "files_by_key": files_by_key,
    "vocabulary_check": vocabulary_check,
    "dedupe_documents": dedupe_documents,
    "purge_expired": purge_expired,
    "check_requirements": check_requirements,
    "export_accounts": export_accounts,
    "erase_accounts": erase_accounts,
    "erase_stored": erase_stored,
    "decide_retry": decide_retry,
    "reclaim_stalled": reclaim_stalled,
    "retryable_work": retryable_work,
    "status_feed": status_feed,
    "dedupe_dispatch": dedupe_dispatch,
}
ORACLES = {
    "stored_files": STORED_FILES,
    "files_by_key": FILES_BY_KEY,
    "admit_pages": ADMIT_PAGES,
    "vocabulary_check": VOCABULARY_CHECK,
    "dedupe_documents": DEDUPE_DOCUMENTS,
    "purge_expired": PURGE_EXPIRED,
    "check_requirements": CHECK_REQUIREMENTS,
    "export_accounts": EXPORT_ACCOUNTS,
    "erase_accounts": ERASE_ACCOUNTS,
    "erase_stored": ERASE_ACCOUNTS,
    "decide_retry": DECIDE_RETRY,
    "reclaim_stalled": RECLAIM_STALLED,
    "retryable_work": RETRYABLE_WORK,
    "status_feed": STATUS_FEED,
    "dedupe_dispatch": DEDUPE_DISPATCH,
}
