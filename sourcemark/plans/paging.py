"""Registered queries over pages: assembly, boundaries, recognition, blocks, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcemark.operators import assembly as asm
from sourcemark.operators import evidence as ev
from sourcemark.operators import profiles as pf
from sourcemark.operators import sections as sec
from sourcemark.plans.common import DataFrame, SparkSession, sql_round, table
from sourcemark.session import settle


def _line_pages(docs: DataFrame) -> DataFrame:
    """Every line of a document as a page of its own; even documents carry page images."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_n", "text")).select(
        "doc_id", (F.col("_n") + 1).alias("page"), "text", (F.col("doc_id") % 2 == 0).alias("has_image")
    )


_LINES = """
WITH l AS (SELECT doc_id, (unnest(range(1, len(string_split(text, chr(10))) + 1)))::INTEGER AS page,
  unnest(string_split(text, chr(10))) AS text FROM documents)
"""
_SPANS = (
    _LINES
    + """, p AS (SELECT doc_id, page, text, length(trim(text)) < 20 AS bare,
  coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start FROM l),
s AS (SELECT *, (char_start + length(text))::INTEGER AS char_end FROM p)
"""
)


def _summary(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.sha2("text", 256).alias("text_hash"),
        F.col("page_count").cast("bigint").alias("page_count"),
        F.array_join("pages_without_text", ",").alias("pages_without_text"),
        F.element_at("pages", -1)["char_end"].alias("last_end"),
        "outcome",
    )


def _summary_sql(ctes: str, image: str) -> str:
    return f"""{ctes}, d AS (SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text_hash,
  count(*) AS page_count, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (bare), '') AS pages_without_text,
  max(char_end) AS last_end, count(*) FILTER (bare) AS bare FROM s GROUP BY doc_id)
SELECT doc_id, text_hash, page_count, pages_without_text, last_end,
  CASE WHEN bare = page_count AND {image} THEN 'no_text_layer' WHEN bare = page_count THEN 'empty'
    WHEN bare > 0 THEN 'partially_scanned' ELSE 'ok' END AS outcome FROM d"""


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(asm.assemble_documents(_line_pages(table(spark, sf_dir, "documents")), "has_image"))


def assemble_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text"
    )
    return _summary(asm.assemble_documents(turns))


_TURNS = """
WITH l AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, text FROM conversations),
p AS (SELECT doc_id, page, text, length(trim(text)) < 20 AS bare,
  coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start FROM l),
s AS (SELECT *, (char_start + length(text))::INTEGER AS char_end FROM p)
"""


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut back out of the assembled text, through the stored row form of the spans."""
    documents = asm.assemble_documents(_line_pages(table(spark, sf_dir, "documents")))
    rows = asm.explode_pages(documents)
    nested = asm.nest_pages(rows)
    again = asm.explode_pages(documents.drop("pages").join(nested, "doc_id"))
    return again.select("doc_id", "page", "char_start", "char_end", F.sha2("text", 256).alias("text_hash"))


def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every 500th character, and of one offset before and one past the text."""
    documents = asm.assemble_documents(_line_pages(table(spark, sf_dir, "documents")))
    at = F.concat(
        F.array(F.lit(-5), F.char_length("text") + 50),
        F.sequence(F.lit(0), F.char_length("text"), F.lit(500)),
    )
    offsets = documents.select("doc_id", F.explode(at).alias("offset"))
    return asm.pages_of_offsets(documents, offsets)


PAGE_OF_OFFSET = (
    _SPANS
    + """, d AS (SELECT doc_id, max(char_end) AS n FROM s GROUP BY doc_id),
o AS (SELECT doc_id, unnest(list_concat([-5, n + 50], range(0, n + 1, 500)))::INTEGER AS "offset" FROM d)
SELECT o.doc_id, o."offset", coalesce(s.page, 1)::INTEGER AS page
FROM o ASOF LEFT JOIN s ON o.doc_id = s.doc_id AND o."offset" >= s.char_start"""
)


def _words(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.when(F.col("l_tax") == 0, " ").otherwise("w").alias("text"),
        F.when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"),
    )


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asm.page_confidence(_words(table(spark, sf_dir, "lineitem")))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


PAGE_CONFIDENCE = """
SELECT l_orderkey AS doc_id, l_linenumber AS page,
  round(coalesce(avg(l_quantity * 2) FILTER (l_tax <> 0 AND l_discount <> 0), 0.0), 6) AS mean_confidence,
  count(*) FILTER (l_tax <> 0 AND l_discount <> 0) AS words
FROM lineitem GROUP BY ALL"""


def merge_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence gate, page budget and replacement, then the document outcome."""
    pages = _line_pages(table(spark, sf_dir, "documents")).withColumn(
        "has_image", (F.col("doc_id") + F.col("page")) % 3 != 0
    )
    recognised = pages.select(
        "doc_id",
        "page",
        F.when(
            F.col("page") % 4 == 0, "short"
        ).otherwise(F.concat(F.lit("recognised text\r\nof page "), F.col("page").cast("string"))).alias("text"),
    )
    words = pages.select(
        "doc_id", "page", F.lit("w").alias("text"), ((F.col("doc_id") * 37 + F.col("page") * 11) % 101).cast("double").alias("conf")
    )
    gated = asm.gate_recognised(recognised, words, 30.0)
    merged = asm.merge_recognised(pages, gated, 3)
    over = merged.groupBy("doc_id").agg(F.count_if("over_budget").alias("over_budget"))
    documents = asm.assemble_documents(merged, "has_image")
    return documents.join(over, "doc_id").select(
        "doc_id",
        F.sha2("text", 256).alias("text_hash"),
        F.array_join("pages_from_ocr", ",").alias("pages_from_ocr"),
        F.array_join("pages_without_text", ",").alias("pages_without_text"),
        "outcome",
        "used_ocr",
        "over_budget",
    )


MERGE_RECOGNISED = (
    _LINES
    + """, e AS (SELECT *, (doc_id + page) % 3 <> 0 AS image,
    (length(trim(text)) < 20 AND (doc_id + page) % 3 <> 0)::INTEGER AS eligible,
    CASE WHEN (doc_id * 37 + page * 11) % 101 < 30 THEN '' WHEN page % 4 = 0 THEN 'short'
      ELSE 'recognised text' || chr(10) || 'of page ' || page END AS read FROM l),
t AS (SELECT *, sum(eligible) OVER (PARTITION BY doc_id ORDER BY page) AS turn FROM e),
m AS (SELECT doc_id, page, image, eligible = 1 AND turn > 3 AS over_b,
    eligible = 1 AND turn <= 3 AND length(trim(read)) >= 20 AS ocr, text, read FROM t),
x AS (SELECT *, CASE WHEN ocr THEN read ELSE text END AS final FROM m),
d AS (SELECT doc_id, sha256(string_agg(final, chr(10) || chr(10) ORDER BY page)) AS text_hash,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (ocr), '') AS pages_from_ocr,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (length(trim(final)) < 20), '') AS pages_without_text,
  count(*) FILTER (length(trim(final)) < 20) AS bare, count(*) AS n, bool_or(image) AS image,
  bool_or(ocr) AS used_ocr, count(*) FILTER (over_b) AS over_budget FROM x GROUP BY doc_id)
SELECT doc_id, text_hash, pages_from_ocr, pages_without_text,
  CASE WHEN bare = n AND image THEN 'no_text_layer' WHEN bare = n THEN 'empty'
    WHEN bare > 0 THEN 'partially_scanned' ELSE 'ok' END AS outcome, used_ocr, over_budget FROM d"""
)


def quality_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of every document against its own lines."""
    docs = table(spark, sf_dir, "documents").withColumn("page", F.lit(1))
    readings = F.array(
        F.struct(F.lit("clean").alias("variant"), F.col("text").alias("text")),
        F.struct(F.lit("lower").alias("variant"), F.lower("text").alias("text")),
        F.struct(F.lit("spaceless").alias("variant"), F.replace("text", F.lit(" "), F.lit("")).alias("text")),
    )
    pages = docs.select("doc_id", "page", F.inline(readings))
    known = docs.select("doc_id", "page", F.explode(F.split("text", "\n", -1)).alias("line"))
    words = pages.select(
        "variant",
        F.lit("w").alias("text"),
        ((F.col("doc_id") * F.char_length("variant")) % 101 - 1).cast("double").alias("conf"),
    )
    out = asm.quality_sweep(pages, words, known)
    return out.select(
        "variant",
        F.col("lines_found").cast("bigint").alias("lines_found"),
        F.col("lines_known").cast("bigint").alias("lines_known"),
        F.col("chars").cast("bigint").alias("chars"),
        F.round("mean_confidence", 6).alias("mean_confidence"),
    )


QUALITY_SWEEP = """
WITH r AS (SELECT doc_id, 'clean' AS variant, text AS seen, text FROM documents
  UNION ALL SELECT doc_id, 'lower', lower(text), text FROM documents
  UNION ALL SELECT doc_id, 'spaceless', replace(text, ' ', ''), text FROM documents),
k AS (SELECT variant, seen, unnest(string_split(text, chr(10))) AS line FROM r),
f AS (SELECT variant, count(*) FILTER (contains(seen, line)) AS lines_found, count(*) AS lines_known FROM k GROUP BY variant),
c AS (SELECT variant, sum(length(regexp_replace(seen, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars,
  round(coalesce(avg((doc_id * length(variant)) % 101 - 1) FILTER ((doc_id * length(variant)) % 101 - 1 >= 0), 0.0), 6) AS mean_confidence
  FROM r GROUP BY variant)
SELECT variant, lines_found, lines_known, chars, mean_confidence FROM f JOIN c USING (variant)"""


def assemble_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks; a line with commas becomes a table whose rows hold its clauses."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "line"))
    rows = lines.select(
        "doc_id", "block", F.contains("line", F.lit(",")).alias("is_table"), F.posexplode(F.split("line", "\\.", -1)).alias("row", "part")
    ).where("is_table").unionByName(
        lines.where(~F.contains("line", F.lit(","))).select(
            "doc_id", "block", F.lit(False).alias("is_table"), F.lit(0).alias("row"), F.col("line").alias("part")
        )
    )
    cells = rows.select(
        "doc_id",
        "block",
        "row",
        "is_table",
        F.posexplode(F.when(F.col("is_table"), F.split("part", ",", -1)).otherwise(F.array("part"))).alias("cell", "text"),
    )
    out = asm.assemble_blocks(cells)
    return out.select(
        "doc_id", F.sha2("text", 256).alias("text_hash"), F.col("page_count").cast("bigint").alias("page_count"), "outcome"
    )


ASSEMBLE_BLOCKS = (
    _LINES
    + """, r AS (SELECT doc_id, page, CASE WHEN contains(text, ',')
    THEN array_to_string(list_transform(string_split(text, '.'),
      lambda p: array_to_string(list_transform(string_split(p, ','), lambda c: trim(c)), chr(9))), chr(10))
    ELSE text END AS b FROM l),
d AS (SELECT doc_id, string_agg(b, chr(10) ORDER BY page) AS t FROM r GROUP BY doc_id)
SELECT doc_id, sha256(t) AS text_hash, 1::BIGINT AS page_count,
  CASE WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 20 THEN 'empty' ELSE 'ok' END AS outcome FROM d"""
)

# Common words of the four languages stand in for headings, each on a line of its own.
_HEADINGS = {"the": "experience", "of": "skills", "and": "education", "la": "skills", "de": "contact", "die": "skills"}


def _sectioned(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", r" (the|of|and|la|de|die) ", "\n$1\n")
    return sec.sectionize(docs.select("doc_id", text.alias("text")), _HEADINGS)


_SECTIONS = r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(text, ' (the|of|and|la|de|die) ', chr(10) || '\1' || chr(10), 'g'), chr(10)) AS ls
  FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS line FROM t),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no, line,
  MAP {'the':'experience','of':'skills','and':'education','la':'skills','de':'contact','die':'skills'}[lower(line)] AS h FROM u WHERE line <> ''),
s AS (SELECT doc_id, line_no, line, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '_preamble') AS section, h FROM n),
k AS (SELECT doc_id, line_no, section, line FROM s WHERE h IS NULL)
"""


def sectionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _sectioned(table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id", "section").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("line_no").cast("bigint").alias("line_numbers"),
        F.sum(F.char_length("line")).cast("bigint").alias("chars"),
    )


SECTIONIZE = (
    _SECTIONS
    + "SELECT doc_id, section, count(*) AS lines, sum(line_no)::BIGINT AS line_numbers, sum(length(line))::BIGINT AS chars FROM k GROUP BY ALL"
)


def list_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sec.skills(_sectioned(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("part_no").cast("bigint").alias("part_no"),
        "skill",
    )


LIST_SKILLS = (
    _SECTIONS
    + """, p AS (SELECT doc_id, line_no, list_filter(list_transform(regexp_split_to_array(line, '[,;/·|]'), lambda x: trim(x)), lambda x: x <> '') AS ps
  FROM k WHERE section = 'skills')
SELECT doc_id, line_no, unnest(range(len(ps))) AS part_no, unnest(ps) AS skill FROM p"""
)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and headlines; words that occur in the texts stand in for level hints too."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Person\n"), F.element_at(F.array(F.lit("Senior "), F.lit("Jr. "), F.lit("Head of the "), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("text")).alias("text")
    )
    return sec.identity(docs)


IDENTITY = """
WITH t AS (SELECT doc_id, 'Person' || chr(10) || ['Senior ','Jr. ','Head of the ',''][(doc_id % 4 + 1)::INTEGER] || text AS t FROM documents),
u AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS i, trim(unnest(string_split(t, chr(10)))) AS line FROM t),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, line FROM u WHERE line <> ''),
h AS (SELECT doc_id, max(line) FILTER (k = 1) AS full_name, max(line) FILTER (k = 2) AS headline FROM n GROUP BY doc_id)
SELECT doc_id, full_name, headline, CASE WHEN headline IS NULL THEN 'unknown'
  WHEN lower(headline) LIKE '%lead%' OR lower(headline) LIKE '%principal%' OR lower(headline) LIKE '%head of%' THEN 'lead'
  WHEN lower(headline) LIKE '%senior%' OR lower(headline) LIKE '%sr.%' THEN 'senior'
  WHEN lower(headline) LIKE '%junior%' OR lower(headline) LIKE '%jr.%' OR lower(headline) LIKE '%intern%' THEN 'junior'
  ELSE 'unknown' END AS seniority FROM h"""


def _role_lines(docs: DataFrame) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(". "), F.lit(" (ab - cd)\n")), F.lit(", "), F.lit(" — "))
    return sec.sectionize(docs.select("doc_id", text.alias("text")))


_ROLES = """
WITH t AS (SELECT doc_id, string_split(replace(replace(text, '. ', ' (ab - cd)' || chr(10)), ', ', ' — '), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS line FROM t),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no, line FROM u WHERE line <> '')
"""


def role_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sec.roles(_role_lines(table(spark, sf_dir, "documents")), sec.PREAMBLE)
    return out.drop("quote").withColumn("line_no", F.col("line_no").cast("bigint"))


_ROLE_RE = f"'{sec.ROLE_LINE}'"
ROLE_LINES = _ROLES + "SELECT doc_id, line_no, " + ", ".join(
    f"trim(regexp_extract(line, {_ROLE_RE}, {i})) AS \"{name}\"" for i, name in enumerate(("company", "title", "start", "end"), 1)
) + f" FROM n WHERE regexp_matches(line, {_ROLE_RE})"


def education_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sec.education(_role_lines(table(spark, sf_dir, "documents")), sec.PREAMBLE)
    return out.drop("quote").withColumn("line_no", F.col("line_no").cast("bigint"))


_EDU_RE = f"'{sec.EDUCATION_LINE}'"
EDUCATION_LINES = _ROLES + "SELECT doc_id, line_no, " + ", ".join(
    f"trim(regexp_extract(line, {_EDU_RE}, {i})) AS {name}" for i, name in enumerate(("institution", "credential"), 1)
) + f" FROM n WHERE regexp_matches(line, {_EDU_RE})"


def extract_and_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based extraction of every document, then verification of what it quoted."""
    text = F.concat(F.lit("Person\nSenior "), F.regexp_replace("text", r" (the|of|la|die) ", "\nskills\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    # The extraction is recorded before it is verified.
    return pf.verified_profile(settle(sec.raw_profile(docs)), docs).select(
        "doc_id",
        F.col("full_name.value").alias("full_name"),
        "seniority",
        F.size("skills").cast("bigint").alias("skills"),
        F.col("stats.verified").alias("verified"),
        F.col("stats.dropped").alias("dropped"),
        "stats.hallucination_rate",
    )


EXTRACT_AND_VERIFY = rf"""
WITH t AS (SELECT doc_id, string_split('Person' || chr(10) || 'Senior ' || regexp_replace(text, ' (the|of|la|die) ', chr(10) || 'skills' || chr(10), 'g'), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS line FROM t),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, line FROM u WHERE line <> ''),
f AS (SELECT *, coalesce(bool_or(lower(line) = 'skills') OVER (PARTITION BY doc_id ORDER BY k), false) AS in_skills FROM n),
q AS (SELECT doc_id, line AS quote, false AS is_skill FROM f WHERE k <= 2 AND NOT in_skills
  UNION ALL SELECT doc_id, line, false FROM f WHERE k = 2 AND NOT in_skills
  UNION ALL SELECT doc_id, trim(unnest(regexp_split_to_array(line, '[,;/·|]'))), true FROM f WHERE in_skills AND lower(line) <> 'skills'),
g AS (SELECT doc_id, count(*) FILTER (is_skill AND length(quote) >= 4) AS skills, count(*) FILTER (length(quote) >= 4) AS verified,
  count(*) FILTER (length(quote) < 4) AS dropped FROM q WHERE quote <> '' GROUP BY doc_id)
SELECT doc_id, 'Person' AS full_name, 'senior' AS seniority, skills, verified, dropped,
  {sql_round("(dropped::DOUBLE / (verified + dropped))", 4)} AS hallucination_rate FROM g"""

QUERIES = {
    "assemble_pages": assemble_pages,
    "assemble_turns": assemble_turns,
    "page_spans": page_spans,
    "page_of_offset": page_of_offset,
    "page_confidence": page_confidence,
    "merge_recognised": merge_recognised,
    "quality_sweep": quality_sweep,
    "assemble_blocks": assemble_blocks,
    "sectionize": sectionize,
    "list_skills": list_skills,
    "identity": identity,
    "role_lines": role_lines,
    "education_lines": education_lines,
    "extract_and_verify": extract_and_verify,
}
ORACLES = {
    "assemble_pages": _summary_sql(_SPANS, "doc_id % 2 = 0"),
    "assemble_turns": _summary_sql(_TURNS, "false"),
    "page_spans": _SPANS + "SELECT doc_id, page, char_start, char_end, sha256(text) AS text_hash FROM s",
    "page_of_offset": PAGE_OF_OFFSET,
    "page_confidence": PAGE_CONFIDENCE,
    "merge_recognised": MERGE_RECOGNISED,
    "quality_sweep": QUALITY_SWEEP,
    "assemble_blocks": ASSEMBLE_BLOCKS,
    "sectionize": SECTIONIZE,
    "list_skills": LIST_SKILLS,
    "identity": IDENTITY,
    "role_lines": ROLE_LINES,
    "education_lines": EDUCATION_LINES,
    "extract_and_verify": EXTRACT_AND_VERIFY,
}
