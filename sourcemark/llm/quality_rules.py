"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in column expression; no user function runs. Words are
``[^\\x20\\x09-\\x0D]+`` of the whole text. Equal windows are found by sorting 64-bit hashes of
five words, so a text of any length costs n log n and nothing leaves its row.

Edge cases: a null or empty text has no words, all counts are 0 and it fails the base rule
(fewer than ten words). Repeated rows each give their own row. Extra columns are ignored, also
those named like a measure. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import WORD, let

WINDOW = 5

# Frequent function words, two to five letters; written in lower case and capitalised.
STOP_WORDS = (
    "the and of to in is that for it with as was on be by this are at from or an "
    "le la les de des du et un une en que qui dans pour par sur est au avec "
    "der die das und ein eine zu den von mit ist im auf für nicht dem "
    "el los las y una del se por con para su lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text of at least ``least_words`` words whose ``measure`` leaves [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


# Bounds as decimal ratios; a text is kept if no rule rejects it.
RULES = (
    Rule("mean_word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("longest_line", "chars_per_line", high=100_000.0),
    Rule("symbols", "symbols_per_word", high=0.20),
    Rule("exclamations", "exclamations_per_word", high=0.35, least_words=10),
    Rule("capitals", "capital_share", high=0.60, least_words=10),
    Rule("stop_words", "stop_share", low=0.02, least_words=50),
    Rule("repeated_lines", "repeated_line_share", high=0.60, least_words=20),
    Rule("bullets", "bullet_line_share", high=0.90, least_words=20),
    Rule("ellipses", "ellipsis_line_share", high=0.50, least_words=20),
)

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in ``words``."""

    def covered(pairs: Column) -> Column:
        def near(i: Column, step: int) -> Column:
            return F.coalesce(F.get(pairs, i + step)["h"], F.lit(None).cast("bigint"))

        found = F.filter(
            pairs,
            lambda x, i: F.coalesce(x["h"] == near(i, 1), F.lit(False))
            | ((i > 0) & F.coalesce(x["h"] == near(i, -1), F.lit(False))),
        )
        at = F.sort_array(F.transform(found, lambda x: x["at"]))
        return let(
            at,
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))
                ),
                F.lit(0).cast("bigint"),
                lambda a, b: a + b,
            ),
        )

    def by_hash(h: Column) -> Column:
        count = F.size(h) - (WINDOW - 1)
        starts = F.slice(h, F.lit(1), F.greatest(count, F.lit(0)))
        windows = F.transform(
            starts, lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WINDOW)])
        )
        return let(
            windows,
            lambda w: let(
                F.sort_array(w),
                # Most texts repeat no window; only the others need the places.
                lambda s: F.when(
                    F.exists(
                        F.transform(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False))),
                        lambda same: same,
                    ),
                    let(
                        F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at")))),
                        covered,
                    ),
                ).otherwise(F.lit(0).cast("bigint")),
            ),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def measures(text: Column) -> Column:
    """A struct of all counts of one text."""
    text = F.coalesce(text, F.lit(""))
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]

    def counted(words: Column, lines: Column) -> Column:
        bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
        long = "bigint"
        return F.struct(
            F.size(words).cast(long).alias("n_words"),
            F.length(bare).cast(long).alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast(long).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast(long).alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast(long).alias("n_lines"),
            (F.length(text) - F.length(_without(text, "!"))).cast(long).alias("n_exclamations"),
            (F.length(text) - F.length(_without(text, CAPITALS))).cast(long).alias("n_capitals"),
            F.size(F.filter(words, lambda w: w.isin(stops))).cast(long).alias("n_stops"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•·][\x20\x09]"))).cast(long).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast(long).alias("n_ellipses"),
        )

    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda words: let(_lines(text), lambda lines: counted(words, lines)),
    )


def _ratio(top: str, bottom: str):
    return lambda m: m[top] / F.greatest(m[bottom], F.lit(1)).cast("double")


MEASURES = {
    "mean_word_chars": _ratio("word_chars", "n_words"),
    "chars_per_line": _ratio("word_chars", "n_lines"),
    "symbols_per_word": _ratio("n_symbols", "n_words"),
    "exclamations_per_word": _ratio("n_exclamations", "n_words"),
    "capital_share": _ratio("n_capitals", "word_chars"),
    "stop_share": _ratio("n_stops", "n_words"),
    "repeated_line_share": _ratio("n_dup_lines", "n_lines"),
    "bullet_line_share": _ratio("n_bullets", "n_lines"),
    "ellipsis_line_share": _ratio("n_ellipses", "n_lines"),
}


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """The names of the rules that a text of measures ``m`` breaks, as one array column."""

    def breaks(rule: Rule) -> Column:
        value = MEASURES[rule.measure](m)
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < F.lit(rule.low))
        if rule.high is not None:
            outside = outside | (value > F.lit(rule.high))
        return F.when(outside & (m["n_words"] >= rule.least_words), F.lit(rule.name))

    return F.array_compact(F.array(*[breaks(rule) for rule in rules]))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``broken`` rules and ``kept``."""
    m = F.col("m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return (
        docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
        .select("doc_id", "m", failed.alias("base_failed"), compiled(rules, m).alias("broken"))
        .select(
            "doc_id",
            *[m[c].alias(c) for c in BASE],
            "base_failed",
            (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
            F.array_join("broken", ",").alias("broken"),
        )
    )


def _sql_measure(top: str, bottom: str) -> str:
    return f"({top} / greatest({bottom}, 1)::DOUBLE)"


_SQL = {
    "mean_word_chars": _sql_measure("word_chars", "n_words"),
    "chars_per_line": _sql_measure("word_chars", "n_lines"),
    "symbols_per_word": _sql_measure("n_symbols", "n_words"),
    "exclamations_per_word": _sql_measure("n_exclamations", "n_words"),
    "capital_share": _sql_measure("n_capitals", "word_chars"),
    "stop_share": _sql_measure("n_stops", "n_words"),
    "repeated_line_share": _sql_measure("n_dup_lines", "n_lines"),
    "bullet_line_share": _sql_measure("n_bullets", "n_lines"),
    "ellipsis_line_share": _sql_measure("n_ellipses", "n_lines"),
}


def _sql_rule(rule: Rule) -> str:
    value = _SQL[rule.measure]
    outside = " OR ".join(
        ([f"{value} < {rule.low!r}"] if rule.low is not None else [])
        + ([f"{value} > {rule.high!r}"] if rule.high is not None else [])
    )
    return f"CASE WHEN ({outside}) AND n_words >= {rule.least_words} THEN '{rule.name}' END"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in SQL; windows are compared as texts instead of hashes."""
    stops = ", ".join(f"'{w}'" for x in STOP_WORDS for w in dict.fromkeys((x, x.capitalize())))
    gone = lambda chars: reduce(lambda s, c: f"replace({s}, '{c}', '')", chars, "t")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
),
win AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], chr(10)) AS win
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS i FROM w)
),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(t) - length({gone(SYMBOLS)}))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_exclamations,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(words, lambda x: x IN ({stops}))) AS n_stops,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•·][\\x20\\x09]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN rep USING (rid)
),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',', {", ".join(_sql_rule(rule) for rule in rules)}) AS broken
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken = '' AS kept, broken
FROM v"""
