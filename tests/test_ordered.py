"""Skew-proof pieces against the plain ones, with one key holding most of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcemark.operators import joins, ordered


def skewed(spark, rows=4000):
    key = F.when(F.col("id") % 5 == 0, F.col("id") % 40).otherwise(-1)
    return spark.range(rows).select(
        key.alias("k"), ((F.col("id") * 7919) % 1009).alias("o"), "id", (F.col("id") % 3).alias("v")
    )


def test_number_within(spark):
    df = skewed(spark)
    order = [F.col("o").desc(), F.col("id").asc()]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    got = ordered.number_within(df, ["k"], order, "n")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == df.count()


def test_number_everything(spark):
    got = ordered.number_within(skewed(spark, 500), [], [F.col("o"), F.col("id")], "n", start=0).collect()
    assert sorted(row.n for row in got) == list(range(500))
    assert [row.id for row in sorted(got, key=lambda r: r.n)] == [
        row.id for row in sorted(got, key=lambda r: (r.o, r.id))
    ]


def test_hot_key_spans_slices(spark):
    sliced = ordered.slice_sorted(skewed(spark), ["k"], [F.col("o"), F.col("id")])
    spread = sliced.where("k = -1").select(ordered.SLICE).distinct().count()
    assert spread > 3


def test_previous_within(spark):
    df = skewed(spark)
    along = Window.partitionBy("k").orderBy("o", "id")
    want = df.withColumn("p", F.lag("v").over(along)).withColumn("first", F.row_number().over(along) == 1)
    got = ordered.previous_within(df, ["k"], ["o", "id"], ["v"], "b")
    rows = {(r.k, r.id): (r.p, r.first) for r in want.collect()}
    for row in got.collect():
        value, first = rows[(row.k, row.id)]
        assert (row.b is None) == first
        assert first or row.b.v == value


def test_attach_with_hot_keys(spark):
    many = skewed(spark)
    one = spark.range(-1, 45).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = many.join(one, "k", "left")
    for rows in (10, 100_000):
        got = joins.attach(many, one, ["k"], "left", hot_share=1000, hot_rows=rows)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_bundles_stay_bounded(spark):
    many = skewed(spark)
    one = spark.range(-1, 45).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = joins.attach_bundles(many, one, "k", "b", hot_share=1000, hot_rows=100)
    sizes = [row.n for row in got.select(F.size("b").alias("n")).collect()]
    assert sum(sizes) == many.count() and max(sizes) < 250
