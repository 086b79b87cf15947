"""Locate every proposed quote in the text it is said to come from.

Three tiers, tightest first: verbatim; same words under another whitespace layout; same
characters with whitespace ignored altogether. Offsets are 0-based, half-open code points.
A quote that cannot be located stays in the result with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.functions import text as tx
from sourcemark.functions.numbers import round_exact
from sourcemark.operators.joins import attach_bundles
from sourcemark.session import settle

# The shortest quote that counts as evidence, and the shortest for tier three.
MIN_QUOTE = 4
MIN_SQUEEZED_QUOTE = 8
# The closed vocabularies of outcomes.
MATCH_KINDS = ("exact", "whitespace_collapsed", "whitespace_stripped")
REJECT_REASONS = ("empty", "too_short", "not_found", "unknown_requirement")
SPAN = "struct<quote:string,char_start:int,char_end:int,page:int,match_kind:string,is_ambiguous:boolean>"


def page_of(pages: Column, offset: Column) -> Column:
    """The last page starting at or before ``offset``; page 1 when no boundaries are known."""
    reached = F.filter(pages, lambda page: page["char_start"] <= offset)
    return F.coalesce(
        F.get(reached, F.size(reached) - 1)["page_number"],
        F.get(pages, F.lit(0))["page_number"],
        F.lit(1),
    )


def nth_visible(text: Column, nth: Column) -> Column:
    """0-based index in ``text``, which is short, of its ``nth`` (0-based) non-whitespace character.

    Bisection: every step counts the half it looks at, and walks to it from the start of the text.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.char_length(text) + 1)).cast("int") + 1)
    # The character stands at or behind ``low``, which ``seen`` visible ones precede, and before ``high``.
    start = F.struct(F.lit(0).alias("low"), F.char_length(text).alias("high"), F.lit(0).alias("seen"))
    return F.aggregate(steps, start, lambda acc, _: _halve(text, nth, acc))["low"]


def _halve(text: Column, nth: Column, acc: Column) -> Column:
    middle = F.shiftright(acc["low"] + acc["high"], 1)
    inside = F.char_length(tx.squeeze(F.substr(text, acc["low"] + 1, middle - acc["low"])))

    def narrowed(inside: Column) -> Column:
        before = acc["seen"] + inside > nth
        return F.struct(
            F.when(before, acc["low"]).otherwise(middle).alias("low"),
            F.when(before, middle).otherwise(acc["high"]).alias("high"),
            F.when(before, acc["seen"]).otherwise(acc["seen"] + inside).alias("seen"),
        )

    return F.get(F.transform(F.array(inside), narrowed), F.lit(0))


# Characters between the marks of a text's map.
MAP_STEP = 1_024


def offset_map(text: Column) -> Column:
    """The text in blocks of ``MAP_STEP`` characters with the visible characters of each, in one pass."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MAP_STEP}}}"), F.lit(0))
    return F.transform(blocks, lambda b: F.struct(b.alias("text"), F.char_length(tx.squeeze(b)).alias("visible")))


def placed_by_map(mapped: Column, nth: Column) -> Column:
    """As :func:`nth_visible` of the whole text: the block by its counts, then the place within that block."""
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("seen"), F.lit(False).alias("there"))

    def passed(acc: Column, block: Column) -> Column:
        there = acc["there"] | (acc["seen"] + block["visible"] > nth)
        return F.struct(
            F.when(there, acc["block"]).otherwise(acc["block"] + 1).alias("block"),
            F.when(there, acc["seen"]).otherwise(acc["seen"] + block["visible"]).alias("seen"),
            there.alias("there"),
        )

    def inside(at: Column) -> Column:
        return at["block"] * MAP_STEP + nth_visible(F.get(mapped, at["block"])["text"], nth - at["seen"])

    return F.get(F.transform(F.array(F.aggregate(mapped, start, passed)), inside), F.lit(0))


def _read_quotes(df: DataFrame, quote: str) -> DataFrame:
    """Add the quote as searched for (_q) and why it is not searched for at all (_why)."""
    return df.withColumn("_q", tx.strip(tx.nfc(F.coalesce(F.col(quote), F.lit(""))))).withColumn(
        "_why",
        F.when(F.col("_q") == "", "empty").when(F.char_length("_q") < MIN_QUOTE, "too_short"),
    )


def _looser_texts(df: DataFrame, text: str, needed: Column) -> DataFrame:
    """Add the text with plain spaces, squeezed, collapsed, and as an offset map, where ``needed``."""
    return (
        df.withColumn("_plain", F.when(needed, tx.plain_spaces(F.col(text))))
        .withColumn("_st", tx.squeeze(F.col("_plain")))
        .withColumn("_ct", tx.collapse(F.col("_plain")))
        .withColumn("_map", offset_map(F.col("_plain")))
    )


def _with(claims: Column, names: list[str], **new: Callable[[Column], Column]) -> Column:
    """Each claim of the array with fields added; ``names`` grows along."""
    kept = list(names)
    names += [n for n in new if n not in kept]
    return F.transform(
        claims,
        lambda c: F.struct(
            *[c[n].alias(n) for n in kept if n not in new], *[make(c).alias(n) for n, make in new.items()]
        ),
    )


def _searched(claims: str, names: list[str], text: Column) -> Column:
    return _with(F.col(claims), names, _at=lambda c: F.when(c["_why"].isNull(), tx.first_at(text, c["_q"], F.col("_basic"))))


def _placed(claims: str, names: list[str], text: Column, pages: Column) -> Column:
    """From _q, _why, _at and the looser texts to the outcome fields, claim by claim.

    Each tier is evaluated only for claims the tighter one missed. Looser matches are placed by
    the number of visible characters before them, whatever the length of the quote: one look into
    the text's map, which all claims share, and one into a single block.
    """
    mapped, squeezed_text, collapsed_text = F.col("_map"), F.col("_st"), F.col("_ct")
    exact, collapsed, squeezed = MATCH_KINDS
    out = _with(F.col(claims), names, _pq=lambda c: F.when(c["_at"] == 0, tx.plain_spaces(c["_q"])))
    out = _with(out, names, _sq=lambda c: tx.squeeze(c["_pq"]))
    # Both looser tiers need the squeezed quote inside the squeezed text.
    out = _with(out, names, _sat=lambda c: tx.first_at(squeezed_text, c["_sq"], F.col("_basic")))
    out = _with(out, names, _cq=lambda c: F.when(c["_sat"] > 0, tx.collapse(c["_pq"])))
    out = _with(out, names, _cat=lambda c: tx.first_at(collapsed_text, c["_cq"], F.col("_basic")))
    out = _with(
        out,
        names,
        match_kind=lambda c: F.when(c["_at"] > 0, exact)
        .when(c["_cat"] > 0, collapsed)
        .when((c["_sat"] > 0) & (F.char_length(c["_sq"]) >= MIN_SQUEEZED_QUOTE), squeezed),
    )
    before = lambda c: F.when(
        c["match_kind"] == collapsed,
        F.char_length(tx.squeeze(F.substr(collapsed_text, F.lit(1), c["_cat"] - 1))),
    ).when(c["match_kind"] == squeezed, c["_sat"] - 1)
    out = _with(out, names, _v=before)
    out = _with(
        out,
        names,
        char_start=lambda c: F.when(c["match_kind"] == exact, c["_at"] - 1)
        .when(c["_v"].isNotNull(), placed_by_map(mapped, c["_v"]))
        .cast("int"),
        char_end=lambda c: F.when(c["match_kind"] == exact, c["_at"] - 1 + F.char_length(c["_q"]))
        .when(c["_v"].isNotNull(), placed_by_map(mapped, c["_v"] + F.char_length(c["_sq"]) - 1) + 1)
        .cast("int"),
        occurrences=lambda c: F.when(c["match_kind"] == exact, tx.occurrences(text, c["_q"]))
        .when(c["match_kind"] == collapsed, tx.occurrences(collapsed_text, c["_cq"]))
        .when(c["match_kind"] == squeezed, tx.occurrences(squeezed_text, c["_sq"])),
        reason=lambda c: F.coalesce(c["_why"], F.when(c["match_kind"].isNull(), F.lit("not_found"))),
    )
    return _with(
        out,
        names,
        is_ambiguous=lambda c: c["occurrences"] > 1,
        found=lambda c: F.when(c["match_kind"] == exact, c["_q"]).otherwise(
            F.substr(text, c["char_start"] + 1, c["char_end"] - c["char_start"])
        ),
        page=lambda c: F.when(c["reason"].isNull(), page_of(pages, c["char_start"])),
    )


_WORKING = ("_q", "_why", "_at", "_pq", "_sq", "_sat", "_cq", "_cat", "_v")


def _inlined(df: DataFrame, names: list[str], text: Column, pages: Column, keep: list[str]) -> DataFrame:
    """Place the claims nested in ``_claims`` and only then give each a row.

    The outer form is as good here (no bundle is empty) and keeps Spark from computing the
    array once more in a filter.
    """
    needed = F.exists("_claims", lambda c: c["_at"] == 0)
    derived = _looser_texts(df, "_text", needed)
    placed = derived.select(*keep, _placed("_claims", names, text, pages).alias("_claims"))
    return placed.select(*keep, F.inline_outer("_claims")).drop(*_WORKING)


_NO_PAGES = "array<struct<page_number:int,char_start:int,char_end:int>>"


def locate_quotes(df: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Rows holding a text and a quote: add found, char_start, char_end, match_kind,
    occurrences, is_ambiguous and reason. ``text`` must be NFC already.
    """
    names = ["_q", "_why"]
    read = _read_quotes(df, quote).withColumn("_text", F.col(text)).withColumn("_basic", tx.is_basic(F.col("_text")))
    nested = read.withColumn("_claims", F.array(F.struct(*names))).drop(*names)
    searched = nested.withColumn("_claims", _searched("_claims", names, F.col("_text")))
    return _inlined(searched, names, F.col("_text"), F.lit(None).cast(_NO_PAGES), df.columns).drop("page")


def resolve(claims: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Claims (key, quote, …) against documents (key, text[, pages]) → one outcome per claim.

    Claims are nested per document in bounded bundles, so a text is shuffled once and its looser
    forms are derived once per bundle (and only if some claim of it is not verbatim). Claims are
    placed inside the bundle; only their outcomes are given rows. A claim whose document is
    unknown is reported as not found.
    """
    bundles = attach_bundles(read_quotes(claims), as_sources(docs, key), key, "_claims")
    return place_bundles(bundles, [c for c in claims.columns if c != key], key)


def read_quotes(claims: DataFrame) -> DataFrame:
    """Claims as they are nested: with the quote as searched for, and why it is not searched for at all."""
    return _read_quotes(claims, "quote")


def as_sources(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as they are searched: the text in NFC, what it is made of (once, not once a claim), and the pages if there are any."""
    pages = F.col("pages") if "pages" in docs.columns else F.lit(None)
    read = docs.select(key, tx.nfc(F.col("text")).alias("_text"), pages.cast(_NO_PAGES).alias("_pages"))
    # Of the text in NFC: some ideographs below U+10000 are composed to ones above.
    return read.withColumn("_basic", tx.is_basic(F.col("_text")))


def place_bundles(bundles: DataFrame, columns: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Outcomes of sources with their claims (``columns``, and what :func:`read_quotes` adds) nested as ``_claims``."""
    names = [*columns, "_q", "_why"]
    searched = bundles.withColumn("_text", F.coalesce(F.col("_text"), F.lit(""))).withColumn(
        "_claims", _searched("_claims", names, F.col("_text"))
    )
    return _inlined(searched, names, F.col("_text"), F.col("_pages"), [key])


def split_outcomes(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, dropped): nothing is lost, every dropped claim keeps its original quote.

    Outcomes are written once: both halves read them, and placing claims again would cost as much as the first time.
    """
    resolved = settle(resolved)
    verified = resolved.where(F.col("reason").isNull()).drop("reason")
    located = ("found", "char_start", "char_end", "match_kind", "occurrences", "is_ambiguous", "page")
    dropped = resolved.where(F.col("reason").isNotNull()).drop(*located)
    return verified, dropped


def span_of() -> Column:
    """The resolved columns packed as one citation."""
    return F.struct(
        F.col("found").alias("quote"),
        F.col("char_start"),
        F.col("char_end"),
        F.col("page"),
        F.col("match_kind"),
        F.col("is_ambiguous"),
    )


def _tally(column: str, vocabulary: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(column) == word).alias(f"_{word}") for word in vocabulary]


def _as_map(vocabulary: Sequence[str]) -> Column:
    pairs = [part for word in vocabulary for part in (F.lit(word), F.coalesce(F.col(f"_{word}"), F.lit(0)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def claim_rate(dropped: Column, total: Column) -> Column:
    """Share of claims that could not be located; 0.0 where there are none."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        round_exact(dropped.cast("double") / total.cast("double"), 4)
    )


def counters() -> list[Column]:
    """Aggregates over resolved claims; :func:`stats_of` reads them."""
    return [
        F.count_if(F.col("reason").isNull()).alias("_verified"),
        F.count_if(F.col("reason").isNotNull()).alias("_dropped"),
        *_tally("match_kind", MATCH_KINDS),
        *_tally("reason", REJECT_REASONS),
    ]


def stats_of() -> list[Column]:
    """The reported counters, zero where a group had no claim."""
    verified, dropped = (F.coalesce(F.col(c), F.lit(0)) for c in ("_verified", "_dropped"))
    return [
        verified.alias("verified"),
        dropped.alias("dropped"),
        (verified + dropped).alias("total_claims"),
        _as_map(MATCH_KINDS).alias("by_match_kind"),
        _as_map(REJECT_REASONS).alias("by_reject_reason"),
        claim_rate(dropped, verified + dropped).alias("hallucination_rate"),
    ]


def evidence_stats(
    resolved: DataFrame, by: Sequence[str], every: DataFrame | None = None
) -> DataFrame:
    """Counters per group; groups of ``every`` without a claim are reported as zeros."""
    counted = resolved.groupBy(*by).agg(*counters())
    if every is not None:
        counted = every.select(*by).distinct().join(counted, list(by), "left")
    return counted.select(*by, *stats_of())
