"""Vector codes against a search of all entries."""

import hashlib
import random

import numpy as np
import pytest

from sourcemark.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, Error int, vector string, `_key` int"


def plain(rows, parts, entries, rounds):
    """Every part against every entry, in Python's whole numbers."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in kept]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for v in cut:
                owned.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for i, points in owned.items():
                books[p][i] = tuple(sum(c) // len(points) for c in zip(*points))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r, v in zip(kept, cut):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return sorted(
        ((i, c, e, sum(o[3] for o in out if o[1] == label), digest) for i, label, c, e in out), key=str
    )


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_search_of_all_entries(spark, seed):
    draw = random.Random(seed)
    # Coarse values, so that equal distances and equal sums abound.
    values = [k / 64 for k in range(-6, 7)] if seed % 2 else [draw.gauss(0, 0.3) for _ in range(500)]
    rows = [(draw.choice([*range(200), None]), [draw.choice(values) for _ in range(32)], draw.choice([1, 2, None])) for _ in range(300)]
    rows += rows[:40]
    rows += [(5, None, 1), (6, [], 1), (7, [0.5, None] * 16, 1), (8, [float("nan")] * 32, 1), (9, [float("inf")] + [0.0] * 31, 2)]
    got = vc.compress(table(spark, rows), parts=16, entries=24, rounds=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 16, 24, 2)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(3, [0.1] * 16, None), (1, [-0.3] * 16, None)]
    got = {r.vec_id: r for r in vc.compress(table(spark, rows)).collect()}
    assert (got[1].code, got[3].code, got[1].error) == ("00" * 16, "01" * 16, 0)
    assert vc.compress(table(spark, [])).collect() == []
    assert vc.compress(table(spark, [(1, None, 1)])).collect() == []


def test_odd_lengths_and_sizes_are_refused(spark):
    with pytest.raises(ValueError):
        vc.compress(table(spark, [(1, [0.1] * 15, 1)]))
    with pytest.raises(Exception, match="lengths other than 16"):
        vc.compress(table(spark, [(1, [0.1] * 16, 1), (2, [0.1] * 32, 1)])).collect()
    with pytest.raises(Exception, match="no exact code"):
        vc.compress(table(spark, [(1, [0.1] * 16, 1), (2, [1e30] * 16, 1)])).collect()


def test_bound_is_strict_and_search_is_exact():
    draw = np.random.default_rng(3)
    books = vc.Codebooks(draw.integers(-3, 4, (2, 64, 3)))
    vectors = draw.integers(-3, 4, (3000, 2, 3))
    codes, distances = vc.EqualAverageSearch(books).nearest(vectors)
    every = ((vectors[:, :, None, :] - books.entries[None]) ** 2).sum(axis=3)
    assert (distances == every.min(axis=2)).all()
    assert (codes == every.argmin(axis=2)).all()


def test_decoding_gives_the_entries(spark):
    draw = random.Random(1)
    rows = [(i, [draw.random() for _ in range(32)], 0) for i in range(100)]
    df = table(spark, rows)
    books = vc.fit_codebooks(df, entries=16)
    for row in vc.decode(vc.encode(df, books), books).collect():
        place = [int(row.code[2 * p : 2 * p + 2], 16) for p in range(16)]
        assert row.vector == [c / 256 for p, e in enumerate(place) for c in books.entries[p, e].tolist()]


def test_many_labels_join_by_shuffle(spark):
    rows = [(i, [float(i % 7)] * 16, i % 50 if i % 3 else None) for i in range(300)]
    coded = vc.encode(table(spark, rows), vc.fit_codebooks(table(spark, rows), entries=4))
    few, many = (sorted(map(str, vc.label_errors(coded, limit).select("vec_id", "label_error").collect())) for limit in (1000, 5))
    assert few == many
