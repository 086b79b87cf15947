"""Alignment against the libraries' whole encodings and a walk over all byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import no_documents, odd_documents, sentence
from tokenizers import Tokenizer

from sourcemark.llm import alignment as al

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["two  spaces   and\ttabs \n\nlines", " leading", "trailing ", "   ", "a▁b", "▁", "<|endoftext|> <s> <0x41> <unk>", "é́x ́y", "\x00 z\x1c q \u0085 w"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def alphabet():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def pieces(libraries, text):
    """Ids and bytes of both encodings of the whole text; none if either differs from a space and the text."""
    a, b = libraries
    letters = alphabet()
    whole = (" " + text).encode()
    in_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    in_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        in_b.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    same = all(b"".join(t for _, t in side) == whole for side in (in_a, in_b))
    return (in_a, in_b) if same and text else ([], [])


def spans(side):
    end = 0
    for i, token in side:
        yield i, end, end + len(token)
        end += len(token)


def plain(libraries, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        in_a, in_b = pieces(libraries, text or "")
        a, b = list(spans(in_a)), list(spans(in_b))
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)] if len(a) < 3000 else walked(a, b)
        counts.update(links)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        low = 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, s, e in side if low <= s and e <= cut) for side in (a, b)) if len(a) < 3000 else "")
            low = cut
        docs.append((doc_id, len(a), len(b), len(cuts), links, ";".join(groups)))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    return [
        (d, na, nb, ng, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(text.encode()).hexdigest() if na and na < 3000 else "" if not na else None)
        for d, na, nb, ng, links, text in docs
    ]


def walked(a, b):
    """Links of long texts: byte by byte."""
    of_a = [k for k, (_, s, e) in enumerate(a) for _ in range(s, e)]
    of_b = [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
    return [(a[x][0], b[y][0]) for x, y in dict.fromkeys(zip(of_a, of_b))]


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def test_align_against_sets():
    draw = random.Random(2)
    for n in range(3000):
        total = draw.randint(1, 60)
        share = [draw.random() for _ in range(3)]
        a, b = [], []
        for end in range(1, total + 1):
            kind = draw.random()
            if end == total or kind < share[0]:
                a.append(end)
                b.append(end)
            elif kind < share[1]:
                a.append(end)
            elif kind < share[2]:
                b.append(end)
        found = al.align(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[i - 1] for i in found.a_ends] == common == [b[j - 1] for j in found.b_ends]
        links = [(sum(e < x for e in a), sum(e < x for e in b)) for x in sorted({*a, *b})]
        assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == links


@pytest.mark.parametrize("length", range(1, 40))
def test_one_to_one_stretches_of_every_length(length):
    def run(*sides):
        return al._run_length(*(np.array(side, dtype=np.int64).tobytes() for side in sides), 0, 0)

    ends = list(range(1, length + 1))
    assert run(ends, ends) == length
    assert run([*ends, length + 2, length + 4], [*ends, length + 1, length + 4]) == length
    assert run([*ends, length + 4], [*ends, length + 1, length + 4]) == length


def test_odd_documents(spark, libraries):
    docs = odd_documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = al.align_documents(docs, A_PATH, B_PATH)
    same(got.collect(), plain(libraries, texts))
    assert al.align_documents(no_documents(spark), A_PATH, B_PATH).collect() == []


def test_texts_in_blocks_and_files_of_any_size(spark, libraries, monkeypatch):
    draw = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, sentence(i, draw.randint(1, 60)) + draw.choice(["", " ", "  x", "\n\ny"])) for i in range(40)]
    want = plain(libraries, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(al.align_documents(docs, A_PATH, B_PATH).collect(), want)
    tokenizers = al.Tokenizers(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    whole = list(al.documents(iter([t for _, t in rows]), tokenizers))
    monkeypatch.setattr(al, "BLOCK", 30)
    monkeypatch.setattr(al, "KEPT_TOKENS", 50)
    for x, y in zip(whole, al.documents(iter([t for _, t in rows]), tokenizers), strict=True):
        assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist()


def test_small_files_give_the_same_sums(spark, monkeypatch):
    docs = spark.createDataFrame([(i, sentence(i % 7, 30)) for i in range(60)], "doc_id long, text string").coalesce(2)
    want = sorted(map(str, al.align_documents(docs, A_PATH, B_PATH).collect()))
    vars_ = vars(al)
    monkeypatch.setitem(vars_, "FILE_LINKS", 200)
    files = al.align_files(docs, A_PATH, B_PATH)
    assert files.count() > 4
    assert sorted(map(str, al.document_sums(files, al.link_counts(files), "bigint").collect())) == want


def test_without_cuts_texts_are_encoded_whole(libraries):
    tokenizers = al.Tokenizers(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert tokenizers.cuts
    texts = [t for _, t in enumerate(TEXTS)] + [sentence(1, 200)]
    cut = [(*r[:4], r[4].tolist()) for r in al.documents(iter(texts), tokenizers)]
    tokenizers.cuts = False
    assert [(*r[:4], r[4].tolist()) for r in al.documents(iter(texts), tokenizers)] == cut


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        al.Tokenizers(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), open(B_PATH, "rb").read())


def test_counts_of_pairs(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the")], "doc_id long, text string")
    counts = al.link_counts(al.align_files(docs, A_PATH, B_PATH)).collect()
    assert sorted(r["count"] for r in counts)[-1] == 3
    assert all(r.pair == (r.a_id << al.B_BITS | r.b_id) for r in counts)
