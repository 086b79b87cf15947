"""Columns against Python's own Unicode tables."""

import random
import unicodedata

from pyspark.sql import functions as F

from sourcemark.functions import text as tx
from sourcemark.functions.numbers import round_exact

SAMPLES = [
    "", "abc", "  padded\t\n", "Straße ẞ İX", "Åกำ é", "　wide  space ",
    "\x1cfs\x1d gs\x1f", "ไทย ทักษะ", "😀 emoji   line", "ŉ ǰ ΐ", "ΩΩ KK",
]


def column(spark, values, *columns):
    return spark.createDataFrame([(v,) for v in values], "t string").select("t", *columns).collect()


def test_nfc_casefold_strip(spark):
    t = F.col("t")
    for row in column(spark, SAMPLES, tx.nfc(t).alias("n"), tx.casefold(t).alias("c"), tx.strip(t).alias("s")):
        assert row.n == unicodedata.normalize("NFC", row.t)
        assert row.c == row.t.casefold()
        assert row.s == row.t.strip()


def test_every_space_is_known(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rows = column(spark, [f"a{s}b" for s in spaces], tx.squeeze(tx.plain_spaces(F.col("t"))).alias("q"))
    assert {row.q for row in rows} == {"ab"}


def test_lines(spark):
    values = ["a\nb", "a\r\nb\n", "", "x\x0by z", "a\n\n"]
    for row in column(spark, values, tx.lines(F.col("t")).alias("l")):
        assert row.l == row.t.splitlines()


def test_tokens(spark):
    values = ["a b Go", "ไทย", "ชำระเงิน", "ดูแลระบบกระทบยอดการชำระเงินด้วย Python และ PostgreSQL", "under_score x1"]
    got = {row.t: row.k for row in column(spark, values, tx.tokens(F.col("t")).alias("k"))}
    assert got["a b Go"] == ["go"]
    assert got["ไทย"] == ["ไทย"]
    grams = got["ชำระเงิน"]
    assert grams[0] == "ชำร" and all(len(g) == 3 for g in grams)
    assert set(grams) <= set(got[values[3]])
    assert {"python", "postgresql"} <= set(got[values[3]])
    assert got["under_score x1"] == ["under_score", "x1"]


def test_round_exact_is_pythons_round(spark):
    rng = random.Random(7)
    values = [d / t for t in (160, 320, 1600, 3, 7, 32, 20000) for d in range(0, t, max(1, t // 97))]
    values += [rng.random() * 10**k for k in range(-5, 5) for _ in range(60)]
    values += [0.03125, 0.00005, 0.00015, 0.00625, 2.675, 1.005, 0.5, 0.0, 1.0, 12345.67895, -0.00625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4, 6):
        for row in df.select("v", round_exact(F.col("v"), digits).alias("r")).collect():
            assert row.r == round(row.v, digits), (row.v, digits)
