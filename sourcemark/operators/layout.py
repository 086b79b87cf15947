"""Reading order of a page, from the boxes of its words.

A page is one sheet of paper: its words fit one row, so per-page arrays are bounded. All
steps keep the (doc_id, page) partitioning of the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The guards that decide what counts as a row, a band and a column gap.
MIN_WORDS = 10
ROW_TOLERANCE = 3.0
BAND_GAP = 1.5
GUTTER_SHARE = 0.04
SIDE_SHARE = 0.15
SIDE_PER_GUTTER = 0.5

PAGE = ["doc_id", "page"]


def anchors_of(tops: Column) -> Column:
    """Row anchors from sorted tops: a word joins the row whose *first* word is near enough."""
    return F.aggregate(
        tops,
        F.array().cast("array<double>"),
        lambda acc, top: F.when(
            (F.size(acc) > 0) & (top - F.element_at(acc, -1) <= ROW_TOLERANCE), acc
        ).otherwise(F.concat(acc, F.array(top))),
    )


def assign_rows(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Words with ``row_no`` (0-based, top to bottom) within each page."""
    by = by or PAGE
    rest = [c for c in words.columns if c not in by]
    pages = words.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_words"))
    anchored = pages.withColumn(
        "_anchors", anchors_of(F.array_sort(F.array_distinct(F.transform("_words", lambda w: w["top"]))))
    )
    return anchored.select(*by, "_anchors", F.inline("_words")).select(
        *by,
        *rest,
        (F.size(F.filter("_anchors", lambda a: a <= F.col("top"))) - 1).alias("row_no"),
    )


def assign_bands(rows: DataFrame) -> DataFrame:
    """Words (with row_no) with ``band_no``: a new band starts after a wide vertical gap."""
    extent = rows.groupBy(*PAGE, "row_no").agg(
        F.min("top").alias("_top"), F.max("bottom").alias("_bottom")
    )
    down = Window.partitionBy(*PAGE).orderBy("row_no")
    median = F.percentile(F.col("_bottom") - F.col("_top"), F.lit(0.5)).over(Window.partitionBy(*PAGE))
    gap = F.col("_top") - F.lag("_bottom").over(down)
    starts = F.when(gap >= BAND_GAP * F.col("_median"), 1).otherwise(0)
    banded = (
        extent.withColumn("_median", median)
        .withColumn("_new", starts)
        .withColumn("band_no", F.sum("_new").over(down).cast("int"))
        .select(*PAGE, "row_no", "band_no")
    )
    return rows.join(banded, [*PAGE, "row_no"])


def gutter_of(words: Column, page_width: Column) -> Column:
    """The widest empty strip of a band if it looks like a column gap, else null.

    ``words``: array of structs starting with (x0, x1). Leftmost wins among equal widths.
    """
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"))))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("reach"), none.alias("left"), none.alias("right"))

    def sweep(acc: Column, w: Column) -> Column:
        gap = w["x0"] - acc["reach"]
        wider = (gap > 0) & (acc["left"].isNull() | (gap > acc["right"] - acc["left"]))
        return F.struct(
            F.greatest(acc["reach"], w["x1"]).alias("reach"),
            F.when(wider, acc["reach"]).otherwise(acc["left"]).alias("left"),
            F.when(wider, w["x0"]).otherwise(acc["right"]).alias("right"),
        )

    widest = F.aggregate(ordered, start, sweep)
    return F.get(
        F.transform(F.array(widest), lambda g: _guarded(words, g["left"], g["right"], page_width)), F.lit(0)
    )


def _guarded(words: Column, left: Column, right: Column, page_width: Column) -> Column:
    before = F.filter(words, lambda w: w["x1"] <= left)
    after = F.filter(words, lambda w: w["x0"] >= right)
    spread = lambda side: F.array_max(F.transform(side, lambda w: w["x1"])) - F.array_min(
        F.transform(side, lambda w: w["x0"])
    )
    width = right - left
    good = (
        (width >= GUTTER_SHARE * page_width)
        & (F.least(F.size(before), F.size(after)) >= SIDE_SHARE * F.size(words))
        & (F.least(spread(before), spread(after)) >= SIDE_PER_GUTTER * width)
    )
    return F.when(good, F.struct(left.alias("left"), right.alias("right")))


def find_bands(words: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per band: boundaries, words and gutter (null without columns).

    ``pages``: doc_id, page, left, top, right, bottom (the page box). Boundaries run through
    the middle of each gap and the outer bands reach the page edges.
    """
    banded = assign_bands(assign_rows(words))
    bands = banded.groupBy(*PAGE, "band_no").agg(
        F.min("top").alias("_top"),
        F.max("bottom").alias("_bottom"),
        F.collect_list(F.struct("x0", "x1")).alias("_words"),
    )
    down = Window.partitionBy(*PAGE).orderBy("band_no")
    above = (F.lag("_bottom").over(down) + F.col("_top")) / 2
    below = (F.col("_bottom") + F.lead("_top").over(down)) / 2
    return (
        bands.withColumn("_above", above)
        .withColumn("_below", below)
        .join(pages, PAGE)
        .select(
            *PAGE,
            "band_no",
            F.coalesce("_above", F.col("top")).alias("band_top"),
            F.coalesce("_below", F.col("bottom")).alias("band_bottom"),
            F.size("_words").alias("words"),
            gutter_of(F.col("_words"), F.col("right") - F.col("left")).alias("gutter"),
            F.struct("left", "top", "right", "bottom").alias("box"),
        )
    )


_BAND = "struct<top:double,bottom:double,gutter:struct<left:double,right:double>>"


def merge_bands(bands: Column) -> Column:
    """Join consecutive columned bands whose gutters overlap; the overlap becomes the gutter."""

    def step(acc: Column, band: Column) -> Column:
        last = F.element_at(acc, -1)
        overlap = (
            (F.size(acc) > 0)
            & last["gutter"].isNotNull()
            & band["gutter"].isNotNull()
            & (band["gutter"]["left"] < last["gutter"]["right"])
            & (last["gutter"]["left"] < band["gutter"]["right"])
        )
        joined = F.struct(
            last["top"].alias("top"),
            band["bottom"].alias("bottom"),
            F.struct(
                F.greatest(last["gutter"]["left"], band["gutter"]["left"]).alias("left"),
                F.least(last["gutter"]["right"], band["gutter"]["right"]).alias("right"),
            ).alias("gutter"),
        )
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when(F.coalesce(overlap, F.lit(False)), grown).otherwise(F.concat(acc, F.array(band)))

    return F.aggregate(bands, F.array().cast(f"array<{_BAND}>"), step)


def clamp(boxes: Column, page: Column) -> Column:
    """Boxes cut to the page; null if that leaves any of them empty."""
    cut = F.transform(
        boxes,
        lambda b: F.struct(
            F.greatest(b["x0"], page["left"]).alias("x0"),
            F.greatest(b["top"], page["top"]).alias("top"),
            F.least(b["x1"], page["right"]).alias("x1"),
            F.least(b["bottom"], page["bottom"]).alias("bottom"),
        ),
    )
    return F.when(~F.exists(cut, lambda b: (b["x1"] <= b["x0"]) | (b["bottom"] <= b["top"])), cut)


def reading_order(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, boxes: regions in reading order, or null to leave the page alone."""
    bands = find_bands(words, pages)
    gathered = bands.groupBy(*PAGE).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "band_no",
                        F.col("band_top").alias("top"),
                        F.col("band_bottom").alias("bottom"),
                        "gutter",
                    )
                )
            ),
            lambda b: F.struct(b["top"].alias("top"), b["bottom"].alias("bottom"), b["gutter"].alias("gutter")),
        ).alias("_bands"),
        F.sum("words").alias("_words"),
        F.first("box").alias("_page"),
    )
    page = F.col("_page")

    def region(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
        return F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))

    def regions(band: Column) -> Column:
        middle = (band["gutter"]["left"] + band["gutter"]["right"]) / 2
        return F.when(
            band["gutter"].isNull(), F.array(region(page["left"], band["top"], page["right"], band["bottom"]))
        ).otherwise(
            F.array(
                region(page["left"], band["top"], middle, band["bottom"]),
                region(middle, band["top"], page["right"], band["bottom"]),
            )
        )

    columned = (F.col("_words") >= MIN_WORDS) & F.exists("_bands", lambda b: b["gutter"].isNotNull())
    boxes = F.flatten(F.transform(merge_bands(F.col("_bands")), regions))
    return gathered.withColumn("_boxes", F.when(columned, boxes)).select(
        *PAGE, clamp(F.col("_boxes"), page).alias("boxes")
    )


def text_in_order(words: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page, text: words region by region, row by row, left to right.

    A word belongs to the region its middle lies in; a page without regions is read as one.
    Words are joined by a space, rows and regions by a newline; empty regions leave no trace.
    """
    placed = words.join(regions, PAGE, "left")
    mid_x = (F.col("x0") + F.col("x1")) / 2
    mid_y = (F.col("top") + F.col("bottom")) / 2
    inside = lambda b: (b["x0"] <= mid_x) & (mid_x < b["x1"]) & (b["top"] <= mid_y) & (mid_y < b["bottom"])
    holding = F.array_position(F.transform("boxes", inside), True).cast("int") - 1
    columns = [c for c in words.columns if c not in PAGE]
    numbered = placed.select(
        *PAGE, *columns, F.when(F.col("boxes").isNull(), 0).otherwise(holding).alias("region_no")
    )
    rows = assign_rows(numbered, [*PAGE, "region_no"])
    lines = rows.groupBy(*PAGE, "region_no", "row_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " "
        ).alias("line")
    )
    return lines.groupBy(*PAGE).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("region_no", "row_no", "line"))), lambda r: r["line"]
            ),
            "\n",
        ).alias("text")
    )
