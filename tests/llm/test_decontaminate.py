"""Decontamination against plain window sets."""

import hashlib
import re

import pytest
from fixtures import no_documents, odd_documents, sentence

from sourcemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text: str | None, items: list[tuple]) -> tuple:
    mine, hit, names = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        size = min(10, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(mine) - size + 1):
            if tuple(mine[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if name is not None:
                    names.add(str(name))
    listed = ",".join(sorted(names))
    return len(mine), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, sentence(11, 35)),
    (2, sentence(12, 10)),
    (13, "Short item here"),
    (4, sentence(11, 35) + " " + sentence(14, 20)),
    (5, None),
    (6, "!!! ..."),
    (None, sentence(16, 15)),
    (7, "ra ra ra ra ra ra ra ra ra ra ra ra"),
    (2, sentence(12, 10)),
    (8, "short ITEM"),
]


def texts() -> list:
    return [
        sentence(11, 35),
        "before " + sentence(11, 35).upper().replace(" ", " -- ") + " after",
        " ".join(sentence(11, 35).split()[3:14]),
        " ".join(sentence(11, 35).split()[3:12]),
        sentence(12, 10) + " " + sentence(12, 10),
        "a short item here and a short item",
        sentence(16, 15),
        "ra " * 40,
        " ".join(sentence(11, 35).split()[20:] + sentence(14, 20).split()),
        sentence(99, 100),
    ]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_hits_are_those_of_window_sets(spark, block_words):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_documents(spark).select("doc_id", "text"))
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted((r.doc_id is None, r.doc_id, *brute(r.text, ITEMS)) for r in docs.where("doc_id is not null").collect())
    found = decontaminate.digest(decontaminate.scan(docs, bench, block_words=block_words))
    got = sorted((False, *r) for r in found.where("doc_id is not null").collect())
    assert got == want
    assert found.count() == docs.count()


def test_long_items_are_matched_over_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 15)
    items = [(1, sentence(21, 100))]
    rows = [(0, sentence(21, 100)), (1, " ".join(sentence(21, 100).split()[9:21]))]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.digest(decontaminate.scan(docs, bench)).collect()))
    assert got == [(d, *brute(t, items)) for d, t in rows]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_cleaned_documents_have_no_hit_and_others_stay(spark, block_words):
    filler = [sentence(50 + i, 60) for i in range(3)]
    passage = sentence(11, 35)
    split = " ".join(passage.split()[:5]) + " " + sentence(12, 10) + " " + " ".join(passage.split()[5:])
    rows = [
        (0, filler[0], 7),
        (1, f"{filler[1]} {passage} {filler[2]}", 7),
        (2, passage, 7),
        (3, f"{filler[0]} {split} {filler[1]}", 7),
        (4, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").withColumn("changed", docs_flag())
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    left = {r.doc_id: r for r in decontaminate.remove_contamination(docs, bench, block_words=block_words).collect()}
    assert sorted(left) == [0, 1, 3, 4]
    assert (left[0].text, left[0].n_chars, left[4].text) == (filler[0], 7, None)
    assert left[1].text.split() == filler[1].split() + filler[2].split()
    assert left[1].n_chars == len(left[1].text)
    assert all(not brute(r.text, ITEMS)[4] for r in left.values())


def test_several_automata_clean_as_one(spark):
    filler = [sentence(70 + i, 60) for i in range(4)]
    passages = [sentence(80 + i, 30) for i in range(6)]
    inner = passages[1].split()
    nested = " ".join([*passages[0].split()[:15], *inner[:9], *passages[2].split(), *inner[9:], *passages[0].split()[15:]])
    rows = [(0, " ".join(filler)), (1, None), (2, ""), (3, passages[3])]
    # Hit to more than half, but to less by each item; what one item leaves joins to another.
    rows += [(10 + i, f"{filler[0][:200]} {passages[i]} {passages[(i + 1) % 6]}") for i in range(6)]
    rows += [(20 + i, f"{filler[i]} {filler[1]} {nested} {filler[2]} {passages[i]}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", docs_flag())
    items = [*enumerate(passages)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for min_words in (12, 1):
        one, several = (
            sorted(map(tuple, decontaminate.remove_contamination(docs, bench, min_words=min_words, block_words=n).collect()))
            for n in (decontaminate.BLOCK_WORDS, 40)
        )
        assert several == one
        assert {r[0] for r in one} == {0, 1, 2, 20, 21, 22, 23}
    assert not any(brute(r[1], items)[4] for r in several)


def docs_flag():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(no_documents(spark), bench).count() == 0
    docs = odd_documents(spark)
    assert decontaminate.digest(decontaminate.scan(docs, none)).where("contaminated").count() == 0
    assert decontaminate.remove_contamination(docs, none).count() == docs.count()
