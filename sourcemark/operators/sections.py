"""Rule-based reading of a document: headings, listed skills, roles, education, requirement lines.

Everything is computed inside the document's own row; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.functions import text as tx
from sourcemark.operators.joins import attach

PREAMBLE = "_preamble"
# Section headings (a whole line, any case) and the section each opens.
HEADINGS = {
    "experience": "experience",
    "work experience": "experience",
    "ประสบการณ์ทำงาน": "experience",
    "ประสบการณ์": "experience",
    "skills": "skills",
    "ทักษะ": "skills",
    "education": "education",
    "การศึกษา": "education",
    "summary": "summary",
    "contact": "contact",
}
# What separates listed skills, and the shape of role and education lines.
SKILL_SEPARATOR = r"[,;/·|]"
ROLE_LINE = r"^(.+?)\s*[—–-]\s*(.+?)\s*\(([^)\-–—]+?)\s*[-–—]\s*([^)]+?)\)\s*$"
EDUCATION_LINE = r"^(.+?)\s*[—–-]\s*(.+?)\s*(?:\(.*\))?$"
# Words in a headline that state a level, strongest first.
LEVEL_HINTS = (
    ("lead", ("lead", "principal", "head of", "หัวหน้า")),
    ("senior", ("senior", "sr.", "อาวุโส")),
    ("junior", ("junior", "jr.", "intern", "ฝึกงาน")),
)


def _heading_map(headings: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in headings.items() for part in pair])


def _read_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _lines (stripped, non-empty) and _folded, the same lines case-folded."""
    kept = F.filter(F.transform(tx.lines(F.col("text")), tx.strip), lambda line: line != "")
    # Fold all lines in one pass over the joined text: no line holds a newline, no fold adds one.
    return docs.select("doc_id", kept.alias("_lines")).withColumn(
        "_folded", F.split(tx.casefold(F.array_join("_lines", "\n")), "\n", -1)
    )


def _parts(docs: DataFrame, headings: dict[str, str] | None) -> DataFrame:
    """doc_id, _parts: consecutive stretches of lines, each under the heading before it."""
    names = _heading_map(HEADINGS if headings is None else headings)
    opened = F.filter(
        F.transform(
            "_folded", lambda line, at: F.struct(at.alias("at"), F.element_at(names, line).alias("name"))
        ),
        lambda h: h["name"].isNotNull(),
    )
    top = F.array(F.struct(F.lit(-1).alias("at"), F.lit(PREAMBLE).alias("name")))
    end = F.size("_lines")

    def stretch(h: Column, nth: Column) -> Column:
        stop = F.coalesce(F.get("_open", nth + 1)["at"], end)
        return F.struct(
            h["name"].alias("section"),
            (h["at"] + 1).alias("base"),
            F.slice("_lines", h["at"] + 2, stop - h["at"] - 1).alias("lines"),
        )

    return (
        _read_lines(docs)
        .withColumn("_open", F.concat(top, opened))
        .select("doc_id", F.transform("_open", stretch).alias("_parts"))
    )


def _section(name: str) -> Column:
    chosen = F.filter("_parts", lambda p: p["section"] == name)
    return F.flatten(F.transform(chosen, lambda p: p["lines"]))


def sectionize(docs: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line_no, section, line: non-empty stripped lines under the last heading seen."""
    # The outer form keeps Spark from grouping the lines twice; the preamble is always a part.
    return (
        _parts(docs, headings)
        .select("doc_id", F.inline_outer("_parts"))
        .select("doc_id", "section", "base", F.posexplode("lines").alias("_nth", "line"))
        .select("doc_id", (F.col("base") + F.col("_nth")).alias("line_no"), "section", "line")
    )


def _skill_parts(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, SKILL_SEPARATOR, -1), tx.strip), lambda part: part != "")


def _role(line: Column) -> Column:
    names = ("company", "title", "start", "end")
    groups = [tx.strip(F.regexp_extract(line, ROLE_LINE, n)).alias(name) for n, name in enumerate(names, 1)]
    return F.struct(*groups, line.alias("quote"))


def _entry(line: Column) -> Column:
    names = ("institution", "credential")
    groups = [tx.strip(F.regexp_extract(line, EDUCATION_LINE, n)).alias(name) for n, name in enumerate(names, 1)]
    return F.struct(*groups, line.alias("quote"))


def skills(lines: DataFrame) -> DataFrame:
    """Listed skills in reading order."""
    return lines.where(F.col("section") == "skills").select(
        "doc_id", "line_no", F.posexplode(_skill_parts(F.col("line"))).alias("part_no", "skill")
    )


def roles(lines: DataFrame, section: str = "experience") -> DataFrame:
    """Lines shaped like a role: company, title, start and end."""
    shaped = lines.where((F.col("section") == section) & F.col("line").rlike(ROLE_LINE))
    return shaped.select("doc_id", "line_no", _role(F.col("line")).alias("_r")).select(
        "doc_id", "line_no", "_r.*"
    )


def education(lines: DataFrame, section: str = "education") -> DataFrame:
    """Lines shaped like an education entry: institution and credential."""
    shaped = lines.where((F.col("section") == section) & F.col("line").rlike(EDUCATION_LINE))
    return shaped.select("doc_id", "line_no", _entry(F.col("line")).alias("_e")).select(
        "doc_id", "line_no", "_e.*"
    )


def seniority(headline: Column) -> Column:
    """The level a headline states; ``unknown`` when it states none."""
    folded = tx.casefold(headline)
    level = F.lit(None).cast("string")
    for name, hints in reversed(LEVEL_HINTS):
        hit = F.lit(False)
        for hint in hints:
            hit = hit | F.contains(folded, F.lit(hint))
        level = F.when(hit, name).otherwise(level)
    return F.coalesce(level, F.lit("unknown"))


def identity(docs: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """Name (first line before any heading), headline (second) and the level it states."""
    return _identified(_parts(docs, headings)).select("doc_id", "full_name", "headline", "seniority")


def _identified(parts: DataFrame) -> DataFrame:
    top = F.get("_parts", F.lit(0))["lines"]
    level = F.when(F.col("headline").isNull(), F.lit("unknown")).otherwise(seniority(F.col("headline")))
    return (
        parts.withColumn("full_name", F.get(top, F.lit(0)))
        .withColumn("headline", F.get(top, F.lit(1)))
        .withColumn("seniority", level)
    )


def raw_profile(docs: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """The rule-based extraction as one raw profile per document, quotes copied from it."""
    named = lambda part: F.struct(part.alias("name"), part.alias("quote"))
    listed = F.flatten(F.transform(_section("skills"), _skill_parts))
    experience = F.filter(_section("experience"), lambda line: line.rlike(ROLE_LINE))
    studied = F.filter(_section("education"), lambda line: line.rlike(EDUCATION_LINE))
    claim = lambda c: F.when(
        F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.col(c).alias("quote"))
    ).alias(c)
    return _identified(_parts(docs, headings)).select(
        "doc_id",
        claim("full_name"),
        claim("headline"),
        F.lit(None).cast("struct<value:string,quote:string>").alias("years_experience"),
        "seniority",
        F.when(F.col("seniority") != "unknown", F.col("headline")).otherwise("").alias("seniority_quote"),
        F.transform(listed, named).alias("skills"),
        F.transform(experience, _role).alias("experiences"),
        F.transform(studied, _entry).alias("education"),
    )


def line_match(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """For each (…, doc_id, label): the first line whose folded text holds the folded label.

    ``asked`` names the document each label is put to, so this is an equi-join on doc_id; the
    whole line becomes the quote. Labels found nowhere give no row.
    """
    ready = _read_lines(docs)
    joined = attach(asked.withColumn("_needle", tx.casefold(F.col("label"))), ready, ["doc_id"], "inner")
    at = F.array_position(F.transform("_folded", lambda line: F.contains(line, F.col("_needle"))), True)
    return (
        joined.withColumn("_at", at)
        .where(F.col("_at") > 0)
        .withColumn("quote", F.get("_lines", (F.col("_at") - 1).cast("int")))
        .drop("_lines", "_folded", "_needle", "_at")
    )
