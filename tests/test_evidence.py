"""The resolver on drawn texts, judged by brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourcemark.functions import text as tx
from sourcemark.operators import evidence as ev

# Ranges of code points that words are drawn from, and what may stand between words.
SCRIPTS = [(0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0xE01, 0xE2E), (0x4E00, 0x4E80), (0x1F600, 0x1F640), (0x21, 0x2F)]
GAPS = [" ", "  ", "\n", "\t", "\n\n ", "\u3000", " \x1f"]


def drawn_text(rng, words):
    """Words of one script each, apart by white space of all sorts."""
    out = []
    for _ in range(words):
        low, high = rng.choice(SCRIPTS)
        out.append("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 9))) + rng.choice(GAPS))
    return "".join(out)


def drawn_case(rng, outcome):
    """A text and a quote that should end in ``outcome``."""
    text = drawn_text(rng, 40)
    words = list(re.finditer(r"\S+", text))
    first = rng.randint(0, 30)
    quote = text[words[first].start() : words[first + 6].end()]
    if outcome == "whitespace_collapsed":
        quote = re.sub(r"\s+", lambda m: rng.choice([g for g in GAPS if g != m.group()]), quote)
    elif outcome == "whitespace_stripped":
        quote = re.sub(r"\s+", "", quote)
    elif outcome == "not_found":
        at = rng.randrange(len(quote))
        quote = quote[:at] + "\u0416\u0416" + quote[at:]
    elif outcome == "too_short":
        quote = rng.choice(GAPS) + text[words[first].start() :][: rng.randint(1, 2)] + rng.choice(GAPS)
    elif outcome == "empty":
        quote = "".join(rng.choices(GAPS, k=rng.randint(0, 3)))
    return text, quote


def locate(spark, pairs):
    df = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(pairs)], "i int, text string, quote string")
    return [row for row in ev.locate_quotes(df).orderBy("i").collect()]


def brute(text, quote):
    """Tier by tier with Python's regular expressions."""
    q = unicodedata.normalize("NFC", quote).strip()
    if not q:
        return "empty", None, None, None
    if len(q) < 4:
        return "too_short", None, None, None
    words = q.split()
    letters = "".join(words)
    tiers = [("exact", re.escape(q)), ("whitespace_collapsed", r"\s+".join(map(re.escape, words)))]
    if len(letters) >= 8:
        tiers.append(("whitespace_stripped", r"\s*".join(map(re.escape, letters))))
    for kind, pattern in tiers:
        hits = list(re.finditer(pattern, text))
        if hits:
            return kind, hits[0].start(), hits[0].end(), len(hits)
    return "not_found", None, None, None


OUTCOMES = ["exact", "whitespace_collapsed", "whitespace_stripped", "not_found", "too_short", "empty"]


@pytest.mark.parametrize("outcome", OUTCOMES)
def test_drawn_cases_of_every_outcome(spark, outcome):
    rng = random.Random(OUTCOMES.index(outcome))
    pairs = [drawn_case(rng, outcome) for _ in range(150)]
    met = 0
    for (text, quote), row in zip(pairs, locate(spark, pairs), strict=True):
        kind, start, end, n = brute(text, quote)
        assert (row.match_kind or row.reason, row.char_start, row.char_end, row.occurrences) == (kind, start, end, n)
        assert row.quote == quote
        assert row.found == (None if start is None else text[start:end])
        assert row.is_ambiguous == (None if n is None else n > 1)
        met += kind == outcome
    # Cases are drawn, so a few may end elsewhere: a change of white space that changes nothing, say.
    assert met > 140


def test_quotes_with_the_signs_of_patterns(spark):
    signs = r"\Q\E[](){}^$.*+?|-&~#%/"
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        words = ["".join(rng.choices(signs, k=rng.randint(2, 6))) for _ in range(8)]
        pairs.append((" ".join(words), rng.choice(["  ", "\n", ""]).join(words[2:6])))
    for (text, quote), row in zip(pairs, locate(spark, pairs), strict=True):
        kind, start, end, n = brute(text, quote)
        assert (row.match_kind or row.reason, row.char_start, row.char_end, row.occurrences) == (kind, start, end, n)


def test_all_occurrences_are_counted(spark):
    pairs = [("qrst " * n, "qrst") for n in (1, 2, 9, 20)]
    assert [(r.occurrences, r.is_ambiguous) for r in locate(spark, pairs)] == [(n, n > 1) for n in (1, 2, 9, 20)]


def test_against_brute_force(spark):
    rng = random.Random(11)
    alphabet = "ab.é😀ก\\[" + "  \n\t　 \x1f"
    pairs = []
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        cut = rng.randint(0, max(0, len(text) - 1))
        quote = text[cut : cut + rng.randint(1, 14)]
        if rng.random() < 0.4:
            quote = re.sub(r"\s+", lambda m: rng.choice(["", " ", "\n "]), quote)
        if rng.random() < 0.2:
            quote = " ".join(quote)
        pairs.append((text, quote))
    for (text, quote), row in zip(pairs, locate(spark, pairs)):
        kind, start, end, n = brute(text, quote)
        assert (row.match_kind or row.reason, row.char_start, row.char_end, row.occurrences) == (
            kind, start, end, n,
        ), (text, quote)


def test_long_quotes_are_placed_like_short_ones(spark):
    text = " ".join(f"word{i}" for i in range(6000))
    squeezed, reflowed = text.replace(" ", ""), text.replace(" ", "\n")
    rows = locate(spark, [(text, squeezed[50:30000]), (text, reflowed[100:40000])])
    assert [row.match_kind for row in rows] == ["whitespace_stripped", "whitespace_collapsed"]
    assert re.sub(r"\s", "", rows[0].found) == squeezed[50:30000]
    assert rows[1].found == text[100:40000].strip()


def test_resolve_reports_every_claim(spark):
    rng = random.Random(21)
    texts = {doc: drawn_text(rng, 60) for doc in range(5)}
    cuts = {doc: sorted(rng.sample(range(1, len(text)), 3)) for doc, text in texts.items()}
    claims = []
    for n in range(200):
        doc = rng.choice([*texts, 99])
        start = rng.randrange(len(texts.get(doc, "x" * 50)) - 20)
        claims.append((doc, n, texts.get(doc, "x" * 50)[start : start + 20] if n % 4 else "not there at all"))
    pages = {doc: list(zip([1, 2, 3, 4], [0, *c], [*c, len(texts[doc])])) for doc, c in cuts.items()}
    docs = spark.createDataFrame(
        [(doc, text, pages[doc] if doc else None) for doc, text in texts.items()],
        "doc_id long, text string, pages array<struct<page_number:int,char_start:int,char_end:int>>",
    )
    outcomes = ev.resolve(spark.createDataFrame(claims, "doc_id long, claim_id int, quote string"), docs)
    got = {row.claim_id: row for row in outcomes.collect()}
    assert len(got) == len(claims)
    verified, reasons = {}, {}
    for doc, n, quote in claims:
        kind, start, _, _ = brute(texts[doc], quote) if doc in texts else ("not_found", None, None, None)
        assert (got[n].match_kind or got[n].reason, got[n].char_start) == (kind, start)
        if start is not None:
            assert got[n].page == (1 if doc == 0 else max(p for p, low, _ in pages[doc] if low <= start))
        into = reasons if start is None else verified
        into.setdefault(doc, []).append(kind)
    for row in ev.evidence_stats(outcomes, ["doc_id"], docs).collect():
        ok, bad = verified.get(row.doc_id, []), reasons.get(row.doc_id, [])
        assert row.by_match_kind == {k: ok.count(k) for k in ok}
        assert row.by_reject_reason == {k: bad.count(k) for k in bad}
        assert row.hallucination_rate == round(len(bad) / (len(ok) + len(bad)), 4)


def test_documents_without_claims_have_rate_zero(spark):
    docs = spark.createDataFrame([(1, "text of one"), (2, "text of two")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "text of one")], "doc_id long, quote string")
    stats = {row.doc_id: row for row in ev.evidence_stats(ev.resolve(claims, docs), ["doc_id"], docs).collect()}
    assert (stats[2].total_claims, stats[2].hallucination_rate, stats[2].by_match_kind) == (0, 0.0, {})


def test_input_order_does_not_matter(spark):
    rng = random.Random(8)
    cases = [drawn_case(rng, OUTCOMES[n % 4]) for n in range(24)]
    docs = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(cases)], "doc_id long, text string")
    claims = spark.createDataFrame([(n, n, quote) for n, (_, quote) in enumerate(cases)], "doc_id long, claim_id int, quote string")
    a = sorted(map(str, ev.resolve(claims, docs).collect()))
    b = sorted(map(str, ev.resolve(claims.repartition(7, "quote"), docs.repartition(3)).collect()))
    assert a == b


def test_texts_stay_out_of_the_rows_of_claims(spark):
    docs = spark.createDataFrame([(1, "some text of one document")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "text of one")], "doc_id long, quote string")
    plan = ev.resolve(claims, docs)._jdf.queryExecution().optimizedPlan().toString()
    (generate,) = [line for line in plan.splitlines() if "Generate" in line]
    assert "outer" in generate.lower() or ", true, [" in generate
    assert not [line for line in plan.splitlines() if "Filter" in line and "instr" in line]
    below = plan.split("Generate")[1].splitlines()[1]
    assert "Project" in below and "_text#" not in below.rpartition("AS _claims")[2]


def test_long_texts_are_placed_through_their_map(spark):
    rng = random.Random(5)
    pairs = []
    for size in (1, 1023, 1024, 1025, 5000, 200_000):
        text = "".join(rng.choice("ab\U0001f600ก  \n　") for _ in range(size)) + "the last words 12345"
        visible = re.sub(r"\s", "", text)
        for _ in range(6):
            at = rng.randrange(len(visible))
            pairs.append((text, visible[at : at + rng.randint(9, 60)]))
        pairs.append((text, "thelastwords12345"))
    for (text, quote), row in zip(pairs, locate(spark, pairs), strict=True):
        kind, start, end, n = brute(text, quote)
        assert (row.match_kind or row.reason, row.char_start, row.char_end, row.occurrences) == (kind, start, end, n)


def test_literal_search_counts_code_points(spark):
    quotes = {"plain": "a.c d", "wide": "\U0001f600 end", "slashes": r"q\E.*\Qz", "composed": "behind"}
    texts = {
        "plain": "axc d a.c d a.c d",
        "wide": "\U0001f600\U0001f600x \U0001f600 end",
        "slashes": r"qz q\E.*\Qz q\E.*\Qz q\E.*\Qz",
        # This ideograph lies below U+10000, its composed form above.
        "composed": "\ufa6c\ufa6c behind",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    claims = spark.createDataFrame(list(quotes.items()), "doc_id string, quote string")
    got = {r.doc_id: (r.found, r.char_start, r.char_end, r.occurrences) for r in ev.resolve(claims, docs).collect()}
    assert got == {
        "plain": ("a.c d", 6, 11, 2),
        "wide": ("\U0001f600 end", 4, 9, 1),
        "slashes": (r"q\E.*\Qz", 3, 11, 3),
        "composed": ("behind", 3, 9, 1),
    }


def test_an_occurrence_is_counted_without_copying_the_text(spark):
    claim = spark.createDataFrame([("abcd " * 3, "abcd")], "text string, quote string")
    counted = claim.select(tx.occurrences(F.col("text"), F.col("quote")).alias("n"))
    assert counted.first().n == 3
    assert "replace(text" not in counted._jdf.queryExecution().analyzed().toString()


def test_both_halves_read_outcomes_placed_once(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "words"), (1, "other")], "doc_id long, quote string")
    halves = ev.split_outcomes(ev.resolve(claims, docs))
    assert [[r.quote for r in half.collect()] for half in halves] == [["words"], ["other"]]
    for half in halves:
        assert "Join" not in half._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_are_verified_once(spark, sf_dir):
    plan = entry.queries()["verified_profile"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1, plan
