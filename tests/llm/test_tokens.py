"""Token counts and token files against the library itself."""

import random
import struct
import unicodedata
import zlib

import pytest
from fixtures import VOCABULARY, no_documents, odd_documents, odd_texts
from tokenizers import Tokenizer

from sourcemark.llm import token_counts, token_files
from sourcemark.llm.vocabulary import WordCache, blocks, split_words


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, library):
    docs = odd_documents(spark)
    want = {(r.doc_id, r.text): (len((r.text or "").encode()), len(library(r.text))) for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = token_counts.token_counts(docs, VOCABULARY).collect()
    assert len(got) == docs.count()
    for row in got:
        sizes = (row.n_bytes, row.n_tokens)
        assert sizes in ([want[row.doc_id, texts[row.doc_id]]] if row.doc_id is not None else list(want.values()))
        assert row.over_limit == (row.n_tokens > 2048)


def test_every_assigned_letter_counts_as_in_the_library(library):
    with open(VOCABULARY, encoding="utf-8") as file:
        merger = token_counts.Merger(file.read())
    wrong = []
    for start in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        assigned = [c for c in chars if unicodedata.category(c) not in ("Cn", "Co")]
        for text in assigned and ["".join(assigned), "a".join(assigned), " ".join(assigned)]:
            if sum(map(merger.count, split_words(text))) != len(library(text)):
                wrong.append((hex(start), text))
    assert not wrong


def test_every_assigned_letter_has_the_ids_of_the_library(library):
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read(), (100, 100))
    wrong = []
    for start in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        assigned = [c for c in chars if unicodedata.category(c) not in ("Cn", "Co")]
        for text in assigned and ["".join(assigned), "a".join(assigned), " ".join(assigned), "Z' s'S 'll\n".join(assigned)]:
            ids = library(text)
            if encoder.ids(text) != struct.pack(f"<{len(ids)}I", *ids):
                wrong.append((hex(start), text))
    assert not wrong


def test_plain_blocks_equal_the_library(library):
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read(), (50, 50))
    draw = random.Random(3)
    signs = ["a", "Ab", "é", "ÿ", "Ź", "'", "'s", "'LL", "’", "12", "3", ".", "...", "<", "<|endoftext|>", "|>", " ", "\n", "\t\r", "_", "ß"]
    for _ in range(4000):
        text = "".join(draw.choices(signs, k=draw.randint(0, 25)))
        ids = library(text)
        assert encoder.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_vocabularies_of_other_rules_are_refused(spark):
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    for encode in (token_counts.token_counts, token_files.tokens_round_trip):
        with pytest.raises(Exception, match="another way"):
            encode(odd_documents(spark), other).collect()


def test_files_hold_the_librarys_ids_in_order(spark, library, tmp_path):
    docs = odd_documents(spark)
    folder = f"file://{tmp_path}/tokens"
    got = token_files.tokens_round_trip(docs, VOCABULARY, folder).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for want, row in zip(rows, sorted(got, key=lambda r: r.start), strict=True):
        ids = [*library(want.text), 1]
        assert (row.doc_id, row.start, row.n_tokens) == (want.doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    files = token_files.read_tokens(spark, folder)
    found = files.where("doc_id = 9")
    assert "EqualTo(doc_id,9)" in found._jdf.queryExecution().toString().replace(" ", "")
    assert found.first()["ids"] == [*library(odd_texts()[9]), 1]


def test_empty_tables(spark, tmp_path):
    docs = no_documents(spark)
    assert token_counts.token_counts(docs, VOCABULARY).count() == 0
    assert token_files.tokens_round_trip(docs, VOCABULARY, f"file://{tmp_path}/none").count() == 0


def test_blocks_and_cache_lose_nothing():
    text = odd_texts()[16]
    assert [w for b in blocks(text, 1000) for w in split_words(b)] == text.split()
    cache = WordCache(lambda words: [w.upper() for w in words], limit=5, longest=6)
    words = text.split()[:500]
    assert [v for i in range(0, 500, 50) for v in cache.lookup(words[i : i + 50])] == [w.upper() for w in words]
