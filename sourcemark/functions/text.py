"""Unicode-exact string columns, all evaluated inside the JVM.

Spark's ``trim``/``lower`` differ from Unicode whitespace and full case folding, so the
classes are spelled out and the two Unicode algorithms come from ICU (shipped with Spark)
through the SQL function ``reflect``. ASCII rows never reach it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode calls white space: those below U+0100 as a regex class
# (a table lookup for the matcher), the others as characters.
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0]"
NARROW_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
WIDE_SPACES = (
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The line boundaries that end a line of text.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The Thai block, and a word run outside it.
THAI_RUN = r"[\x{0E00}-\x{0E7F}]+"
WORD_RUN = r"[\p{L}\p{N}_&&[^\x{0E00}-\x{0E7F}]]+"
THAI_GRAM = 3
MIN_WORD = 2
# U+0300 is the first combining mark: text wholly below it is already composed.
_COMPOSABLE = r"[^\x{0}-\x{2FF}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfc(text: Column) -> Column:
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        F.coalesce(text, F.lit("")),
        F.lit(False),
    )
    return F.when(is_ascii(text), text).when(text.rlike(_COMPOSABLE), composed).otherwise(text)


def casefold(text: Column) -> Column:
    folded = F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"),
        F.lit("foldCase"),
        F.coalesce(text, F.lit("")),
        F.lit(True),
    )
    return F.when(text.isNull() | is_ascii(text), F.lower(text)).otherwise(folded)


def plain_spaces(text: Column) -> Column:
    """Wide white space as single spaces: same length, so offsets stay true."""
    wide = text.rlike(f"[{WIDE_SPACES}]")
    blanks = " " * len(WIDE_SPACES)
    return F.when(is_ascii(text), text).when(wide, F.translate(text, WIDE_SPACES, blanks)).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(NARROW_SPACES + WIDE_SPACES))


def squeeze(text: Column) -> Column:
    """Without any whitespace. ``text`` has plain spaces only, here and in ``collapse``."""
    return F.regexp_replace(text, f"{WHITESPACE}+", "")


def collapse(text: Column) -> Column:
    """Every whitespace run as one space, none at either end."""
    return F.btrim(F.regexp_replace(text, f"{WHITESPACE}+", " "), F.lit(" "))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part``, which is not empty, occurs in ``text`` without overlap."""
    return F.regexp_count(text, literally(part))


def literally(part: Column) -> Column:
    """A pattern that matches ``part`` itself. The matcher skips ahead by the length of such a pattern (Boyer-Moore)."""
    return F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def is_basic(text: Column) -> Column:
    """Whether all code points lie below U+10000, so that the matcher's offsets are code points."""
    return is_ascii(text) | ~text.rlike(r"[\x{10000}-\x{10FFFF}]")


def first_at(text: Column, part: Column, basic: Column) -> Column:
    """1-based offset of the first ``part``, which is not empty, in ``text``; 0 without one. ``basic``: :func:`is_basic` of the text."""
    return F.when(basic, F.regexp_instr(text, literally(part))).otherwise(F.instr(text, part))


def lines(text: Column) -> Column:
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(
        parts
    )


def tokens(text: Column) -> Column:
    """Comparable units of mixed text: words outside Thai, overlapping 3-grams inside it."""
    return fold_tokens(casefold(nfc(text)))


def fold_tokens(folded: Column) -> Column:
    """``tokens`` over text that is already folded (project it first, use it twice)."""
    words = F.filter(
        F.regexp_extract_all(folded, F.lit(WORD_RUN), F.lit(0)),
        lambda word: F.char_length(word) >= MIN_WORD,
    )
    runs = F.regexp_extract_all(folded, F.lit(THAI_RUN), F.lit(0))
    grams = F.transform(
        runs,
        lambda run: F.when(F.char_length(run) <= THAI_GRAM, F.array(run)).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.char_length(run) - (THAI_GRAM - 1)),
                lambda at: F.substr(run, at, F.lit(THAI_GRAM)),
            )
        ),
    )
    return F.concat(words, F.flatten(grams))
