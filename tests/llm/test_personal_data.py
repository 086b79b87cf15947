"""Base spans against the patterns as they stand, and discovery of identifiers from their contexts."""

import hashlib
import random
import re
import time

from fixtures import no_documents, odd_documents, odd_texts

from sourcemark.llm import personal_data as pd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(d) for d in re.findall("[0-9]", match)]
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        return 12 <= len(digits) <= 19 and (sum(digits[-1::-2]) + doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_against_the_patterns():
    draw = random.Random(5)
    pieces = ["1", "23", "4111 1111-1111 1111", "+1 (17) 555-7713", ".", "..", "@", "a@b.c", "é", " ", "-", "255", "256.1.1.1", "x_%"]
    for _ in range(20_000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert pd.base_spans(text) == plain(text), text
    for text in odd_texts():
        assert pd.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    size = 1_000_000
    started = time.monotonic()
    texts = ["1" * size, "a" * size + "@", "a@" * size, "1." * size, "+1" * size, "x" * size + " " + "y" * size + "@z.w", "@" * size]
    for text in texts:
        spans = pd.base_spans(text)
        for _ in pd.candidates(text, spans):
            pass
    assert time.monotonic() - started < 60


def test_candidates_touch_no_span():
    draw = random.Random(6)
    pieces = ["12", "(x7)", "4111111111111111", "+1 (17) 555-7713", " ", "\n", "a@b.c", "é", "word", "1.2.3.4", "u@v", '"k9",']
    for _ in range(5000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 10)))
        spans = pd.base_spans(text)
        for start, end in pd.candidates(text, spans):
            assert re.search("[0-9@]|.", text[start:end]) and not re.search(r"\s", text[start:end])
            assert all(end <= a or b <= start for _, a, b in spans)


def people(spark, copies=1):
    """Six phones behind one phrase, mails behind another, numbers of all sorts behind a third."""
    rows = []
    for i in range(6):
        rows.append((i, f"Please ring my desk +1 (20{i}) 555-010{i} before noon, thanks."))
        rows.append((10 + i, f"write me at u{i}@mail{i}.example.com tonight"))
        rows.append((20 + i, f"it says number +1 (30{i}) 555-010{i} there and says number 12{i} there and says number 1.2.3.{i} there"))
    rows.append((30, "Please ring my desk 0171-555-0199 before noon."))
    rows.append((31, "write me at someone@localhost tonight"))
    rows.append((32, "it says number 0171-555-0198 there"))
    rows.append((33, "Elsewhere 0171-555-0199 stands alone. Room 17."))
    rows.append((34, "Please ring my desk room17 before noon."))
    return spark.createDataFrame(rows * copies, "doc_id long, text string").repartition(4)


def test_patterns_of_seeds_discover_unseen_identifiers(spark):
    found = {r.doc_id: r for r in pd.find_personal_data(people(spark)).collect()}
    texts = {r.doc_id: r.text for r in people(spark).collect()}

    def values(doc):
        return [(s.kind, texts[doc][s.start : s.end]) for s in found[doc].found]

    assert values(30) == [("phone", "0171-555-0199")]
    assert values(31) == [("email", "someone@localhost")]
    # The value is known now, wherever it stands.
    assert values(33) == [("phone", "0171-555-0199")]
    # A context of all sorts of numbers proves nothing, nor does one for a value of another form.
    assert not any(values(doc) for doc in found if doc not in (30, 31, 33))
    assert len(found[20].base) == 2


def test_copies_prove_nothing(spark):
    text = "Please ring my desk +1 (201) 555-0100 before noon"
    rows = [(i, text) for i in range(50)] + [(99, "Please ring my desk 0171-555-0199 before noon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not [r for r in pd.find_personal_data(docs).collect() if r.found]


def test_hot_patterns_and_instances_are_dealt(spark, monkeypatch):
    real = pd.attach
    want = sorted(map(str, pd.digest(pd.find_personal_data(people(spark, 3))).collect()))
    monkeypatch.setattr(pd, "attach", lambda *a, **k: real(*a, **k, hot_share=5, hot_rows=2))
    assert sorted(map(str, pd.digest(pd.find_personal_data(people(spark, 3))).collect())) == want


def test_texts_with_very_many_candidates(spark, monkeypatch):
    docs = people(spark).union(spark.createDataFrame([(40, "n7 " * 500)], "doc_id long, text string"))
    want = sorted(map(str, pd.digest(pd.find_personal_data(docs)).collect()))
    monkeypatch.setattr(pd, "NODES", 7)
    spark_rows = sum((list(pd._scanned(iter([b]))) for b in docs.selectExpr("doc_id as row", "doc_id", "text").toArrow().to_batches()), [])
    assert sum(b.num_rows for b in spark_rows) > docs.count() + 60
    assert len(want) == docs.count()


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = pd.digest(pd.find_personal_data(docs)).collect()
    want = []
    for row in docs.collect():
        spans = plain(row.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = tuple(sum(s[0] == k for s in spans) for k in PATTERNS)
        want.append((row.doc_id, *counts, hashlib.sha256(text.encode()).hexdigest(), text, 0))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pd.digest(pd.find_personal_data(no_documents(spark))).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in pd.digest(pd.find_personal_data(docs)).collect()}
    for row in docs.collect():
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(row.text))
        assert got[row.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[row.doc_id].n_found or got[row.doc_id].spans == text
