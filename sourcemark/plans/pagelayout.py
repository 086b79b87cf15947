"""Registered queries over `conversations` laid out as pages of words and characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcemark.operators import assembly as asm
from sourcemark.operators import geometry as gm
from sourcemark.operators import layout as ly
from sourcemark.plans.common import DataFrame, SparkSession, sql_round, table


def _words(turns: DataFrame) -> DataFrame:
    """Words on an eight-slot grid: a wide gap after slot four (except on every third page),
    uneven tops within a row, and extra space after every tenth row."""
    words = turns.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ", -1)).alias("n", "text"),
    )
    slot, line = F.col("n") % 8, F.floor(F.col("n") / 8)
    x0 = 40 + slot * 50 + F.when((slot >= 4) & (F.col("page") % 3 != 0), 90).otherwise(0)
    top = 50 + line * 14 + F.floor(line / 10) * 40 + (slot % 3)
    return words.select(
        "doc_id",
        "page",
        "n",
        x0.cast("double").alias("x0"),
        (x0 + 40).cast("double").alias("x1"),
        top.cast("double").alias("top"),
        (top + 10).cast("double").alias("bottom"),
        "text",
    )


def _pages(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.lit(-5.0).alias("left"),
        F.lit(-5.0).alias("top"),
        F.lit(595.0).alias("right"),
        F.lit(9000.0).alias("bottom"),
    )


_WORDS_SQL = r"""
w0 AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM conversations),
w1 AS (SELECT doc_id, page, unnest(range(len(ws))) AS n, unnest(ws) AS text FROM w0),
w2 AS (SELECT *, n % 8 AS slot, n // 8 AS line FROM w1),
w AS (SELECT doc_id, page, n, text, line AS row_no, (40 + slot * 50 + CASE WHEN slot >= 4 AND page % 3 <> 0 THEN 90 ELSE 0 END)::DOUBLE AS x0,
  (80 + slot * 50 + CASE WHEN slot >= 4 AND page % 3 <> 0 THEN 90 ELSE 0 END)::DOUBLE AS x1,
  (50 + line * 14 + line // 10 * 40 + slot % 3)::DOUBLE AS top, (60 + line * 14 + line // 10 * 40 + slot % 3)::DOUBLE AS bottom FROM w2)
"""
_BANDS_SQL = (
    _WORDS_SQL
    + """,
r AS (SELECT doc_id, page, row_no, min(top) AS t, max(bottom) AS b FROM w GROUP BY ALL),
m AS (SELECT doc_id, page, median(b - t) AS med FROM r GROUP BY ALL),
g AS (SELECT r.*, CASE WHEN t - lag(b) OVER (PARTITION BY doc_id, page ORDER BY row_no) >= 1.5 * med THEN 1 ELSE 0 END AS new FROM r JOIN m USING (doc_id, page)),
bn AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page ORDER BY row_no))::INTEGER AS band_no FROM g),
x AS (SELECT doc_id, page, band_no, min(t) AS t, max(b) AS b FROM bn GROUP BY ALL),
bw AS (SELECT w.*, band_no FROM w JOIN bn USING (doc_id, page, row_no)),
iv AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, band_no ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bw),
wg AS (SELECT doc_id, page, band_no, reach AS gl, x0 AS gr, row_number() OVER (PARTITION BY doc_id, page, band_no ORDER BY x0 - reach DESC, x0) AS k FROM iv WHERE x0 > reach),
gc AS (SELECT bw.doc_id, bw.page, bw.band_no, any_value(gl) AS gl, any_value(gr) AS gr, count(*) AS n, count(*) FILTER (x1 <= gl) AS nl, count(*) FILTER (x0 >= gr) AS nr,
  max(x1) FILTER (x1 <= gl) - min(x0) FILTER (x1 <= gl) AS sl, max(x1) FILTER (x0 >= gr) - min(x0) FILTER (x0 >= gr) AS sr
  FROM bw LEFT JOIN wg ON wg.doc_id = bw.doc_id AND wg.page = bw.page AND wg.band_no = bw.band_no AND k = 1 GROUP BY ALL),
gt AS (SELECT *, gr - gl >= 0.04 * 600 AND least(nl, nr) >= 0.15 * n AND least(sl, sr) >= 0.5 * (gr - gl) AS ok FROM gc),
bd AS (SELECT x.doc_id, x.page, x.band_no,
  coalesce((lag(b) OVER p + t) / 2, -5.0::DOUBLE) AS band_top, coalesce((b + lead(t) OVER p) / 2, 9000.0::DOUBLE) AS band_bottom,
  n::INTEGER AS words, CASE WHEN ok THEN gl END AS gutter_left, CASE WHEN ok THEN gr END AS gutter_right
  FROM x JOIN gt USING (doc_id, page, band_no) WINDOW p AS (PARTITION BY x.doc_id, x.page ORDER BY x.band_no))
"""
)


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ly.assign_rows(_words(table(spark, sf_dir, "conversations")))
    return out.select("doc_id", "page", F.col("n").cast("bigint").alias("n"), F.col("row_no").cast("bigint").alias("row_no"))


PAGE_ROWS = f"WITH {_WORDS_SQL} SELECT doc_id, page, n, row_no FROM w"


def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return ly.find_bands(_words(turns), _pages(turns)).select(
        "doc_id",
        "page",
        "band_no",
        "band_top",
        "band_bottom",
        "words",
        F.col("gutter.left").alias("gutter_left"),
        F.col("gutter.right").alias("gutter_right"),
    )


PAGE_BANDS = f"WITH {_BANDS_SQL} SELECT * FROM bd"

def clamp_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes a turn, some across the edge of their page and some beyond it: cut, or the page declines."""
    c, t = F.col("conv_id"), F.col("turn")
    box = lambda *edges: F.struct(*[e.cast("double").alias(n) for e, n in zip(edges, ("x0", "top", "x1", "bottom"), strict=True)])
    boxes = F.array(
        box(c % 7 * 40 - 100, F.lit(10), c % 7 * 40 + 20, F.lit(90)),
        box(F.lit(300), c % 11 * 30 - 20, F.lit(560) + t % 5 * 20, c % 11 * 30 + 20),
    )
    page = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("left", 0), ("top", 0), ("right", 600), ("bottom", 300))])
    cut = ly.clamp(F.col("boxes"), F.col("page"))
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", boxes.alias("boxes"), page.alias("page"))
    edge = lambda n, name: F.get("cut", F.lit(n))[name].alias(f"{name}_{n}")
    return made.withColumn("cut", cut).select(
        "conv_id", "turn", F.col("cut").isNull().alias("declined"), *[edge(n, name) for n in (0, 1) for name in ("x0", "top", "x1", "bottom")]
    )


CLAMP_BOXES = """
WITH b AS (SELECT conv_id, turn, greatest(conv_id % 7 * 40 - 100, 0)::DOUBLE AS l, (conv_id % 7 * 40 + 20)::DOUBLE AS r,
  greatest(conv_id % 11 * 30 - 20, 0)::DOUBLE AS t, least(560 + turn % 5 * 20, 600)::DOUBLE AS e, least(conv_id % 11 * 30 + 20, 300)::DOUBLE AS o FROM conversations),
k AS (SELECT *, r > l AND e > 300 AND o > t AS ok FROM b)
SELECT conv_id, turn, NOT ok AS declined, CASE WHEN ok THEN l END AS x0_0, CASE WHEN ok THEN 10.0::DOUBLE END AS top_0, CASE WHEN ok THEN r END AS x1_0,
  CASE WHEN ok THEN 90.0::DOUBLE END AS bottom_0, CASE WHEN ok THEN 300.0::DOUBLE END AS x0_1, CASE WHEN ok THEN t END AS top_1, CASE WHEN ok THEN e END AS x1_1,
  CASE WHEN ok THEN o END AS bottom_1 FROM k"""

_BOXES_SQL = (
    _BANDS_SQL
    + """,
walk AS (
  SELECT doc_id, page, band_no, 0 AS grp, band_top, band_bottom, gutter_left AS l, gutter_right AS r FROM bd WHERE band_no = 0
  UNION ALL
  SELECT b.doc_id, b.page, b.band_no, CASE WHEN j THEN grp ELSE grp + 1 END, b.band_top, b.band_bottom,
    CASE WHEN j THEN greatest(l, b.gutter_left) ELSE b.gutter_left END, CASE WHEN j THEN least(r, b.gutter_right) ELSE b.gutter_right END
  FROM (SELECT k.grp, k.l, k.r, b.*, coalesce(k.l IS NOT NULL AND b.gutter_left < k.r AND k.l < b.gutter_right, false) AS j
    FROM walk k JOIN bd b ON b.doc_id = k.doc_id AND b.page = k.page AND b.band_no = k.band_no + 1) b),
mg AS (SELECT doc_id, page, grp, min(band_top) AS t, max(band_bottom) AS b, arg_max(l, band_no) FILTER (l IS NOT NULL) AS l, arg_max(r, band_no) FILTER (l IS NOT NULL) AS r FROM walk GROUP BY ALL),
ok AS (SELECT doc_id, page FROM bd GROUP BY ALL HAVING sum(words) >= 10 AND count(gutter_left) > 0),
sp AS (SELECT doc_id, page, grp, 0 AS side, -5.0::DOUBLE AS x0, t AS top, coalesce((l + r) / 2, 595.0::DOUBLE) AS x1, b AS bottom FROM mg SEMI JOIN ok USING (doc_id, page)
  UNION ALL SELECT doc_id, page, grp, 1, (l + r) / 2, t, 595.0::DOUBLE, b FROM mg SEMI JOIN ok USING (doc_id, page) WHERE l IS NOT NULL),
bx AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY grp, side) - 1 AS region_no, x0::DOUBLE AS x0, top, x1::DOUBLE AS x1, bottom FROM sp)
"""
)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    regions = ly.reading_order(_words(turns), _pages(turns))
    return regions.select("doc_id", "page", F.posexplode("boxes").alias("region_no", "b")).select(
        "doc_id", "page", F.col("region_no").cast("bigint").alias("region_no"), "b.*"
    )


READING_ORDER = f"WITH RECURSIVE {_BOXES_SQL} SELECT * FROM bx"


def text_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    words = _words(turns)
    return ly.text_in_order(words, ly.reading_order(words, _pages(turns))).select(
        "doc_id", "page", F.sha2("text", 256).alias("text_hash")
    )


TEXT_IN_ORDER = f"""WITH RECURSIVE {_BOXES_SQL},
pl AS (SELECT w.*, coalesce(region_no, 0) AS region_no FROM w LEFT JOIN bx ON bx.doc_id = w.doc_id AND bx.page = w.page
  AND (w.x0 + w.x1) / 2 >= bx.x0 AND (w.x0 + w.x1) / 2 < bx.x1 AND (w.top + w.bottom) / 2 >= bx.top AND (w.top + w.bottom) / 2 < bx.bottom),
li AS (SELECT doc_id, page, region_no, row_no, string_agg(text, ' ' ORDER BY x0) AS line FROM pl GROUP BY ALL)
SELECT doc_id, page, sha256(string_agg(line, chr(10) ORDER BY region_no, row_no)) AS text_hash FROM li GROUP BY ALL"""


def _chars(turns: DataFrame, *keep: str) -> DataFrame:
    """Characters on a grid of eighty to the line, at positions that need rounding; an array a page."""

    def placed(ch, idx):
        column, line = idx % 80, F.floor(idx / 80)
        return F.struct(
            idx.alias("idx"),
            ch.alias("ch"),
            (column * 7.125).alias("x0"),
            (column * 7.125 + 7).alias("x1"),
            (line * 12.375).alias("top"),
            (line * 12.375 + 10).alias("bottom"),
            (~ch.isin(" ", "\n")).alias("has_ink"),
        )

    return turns.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        *keep,
        F.transform(F.split("text", "", -1), placed).alias("chars"),
    )


_CHARS_SQL = f"""
c0 AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, string_split(text, '') AS cs FROM conversations),
c1 AS (SELECT doc_id, page, (unnest(range(len(cs))))::INTEGER AS idx, unnest(cs) AS ch FROM c0),
c2 AS (SELECT *, {sql_round("(idx % 80) * 7.125::DOUBLE", 2)} AS x0, {sql_round("((idx % 80) * 7.125::DOUBLE + 7)", 2)} AS x1,
  {sql_round("(idx // 80) * 12.375::DOUBLE", 2)} AS top, {sql_round("((idx // 80) * 12.375::DOUBLE + 10)", 2)} AS bottom FROM c1),
ink AS (SELECT * FROM c2 WHERE ch NOT IN (' ', chr(10))),
nw AS (SELECT *, CASE WHEN idx = lag(idx) OVER p + 1 AND top = lag(top) OVER p THEN 0 ELSE 1 END AS new FROM ink WINDOW p AS (PARTITION BY doc_id, page ORDER BY idx)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY idx) AS run FROM nw)
"""


def _run_rows(runs: DataFrame) -> DataFrame:
    return runs.select(
        "doc_id",
        "page",
        "char_start",
        "top",
        "bottom",
        F.size("x").alias("chars"),
        F.get("x", F.lit(0))["x0"].alias("first_x0"),
        F.element_at("x", -1)["x1"].alias("last_x1"),
    )


def char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(gm.char_runs(_chars(table(spark, sf_dir, "conversations"))))


CHAR_RUNS = f"""WITH {_CHARS_SQL} SELECT doc_id, page, min(idx) AS char_start, any_value(top) AS top, any_value(bottom) AS bottom, count(*)::INTEGER AS chars,
  arg_min(x0, idx) AS first_x0, arg_max(x1, idx) AS last_x1 FROM rn GROUP BY doc_id, page, run"""


def remap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 37th character is removed from the text."""
    turns = table(spark, sf_dir, "conversations")
    chars = _chars(turns)
    removed = turns.where(F.char_length("text") > 0).select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(37))).alias("idx"),
    )
    return _run_rows(gm.remap_runs(gm.char_runs(chars), removed))


REMAP_RUNS = f"""WITH {_CHARS_SQL},
k AS (SELECT *, (idx - (idx // 37 + 1))::INTEGER AS pos FROM rn WHERE idx % 37 <> 0),
k2 AS (SELECT *, CASE WHEN idx = lag(idx) OVER p + 1 AND run = lag(run) OVER p THEN 0 ELSE 1 END AS cut FROM k WINDOW p AS (PARTITION BY doc_id, page ORDER BY idx)),
k3 AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY idx) AS piece FROM k2)
SELECT doc_id, page, min(pos) AS char_start, any_value(top) AS top, any_value(bottom) AS bottom, count(*)::INTEGER AS chars, arg_min(x0, idx) AS first_x0, arg_max(x1, idx) AS last_x1
FROM k3 GROUP BY doc_id, page, piece"""


def trusted_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages keep other text than their characters spell, some need normalising, some were recognised."""
    n = F.col("conv_id") + F.col("turn")
    # A letter and its accent as two characters.
    apart = F.when(n % 13 == 0, F.concat("text", F.lit("e\u0301"))).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").withColumn("text", apart)
    kept = F.when(n % 5 == 0, F.concat("text", F.lit("."))).when(n % 11 == 0, "").otherwise(F.col("text"))
    pages = turns.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), kept.alias("text"), (n % 7 == 0).alias("from_ocr")
    )
    return gm.trusted_geometry(_chars(turns), pages).select("doc_id", "page", "gap")


TRUSTED_GEOMETRY = """SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'from_ocr' WHEN (conv_id + turn) % 5 = 0 THEN 'text_differs'
  WHEN (conv_id + turn) % 11 = 0 THEN NULL WHEN (conv_id + turn) % 13 = 0 THEN 'normalised' END AS gap FROM conversations"""


def _document_runs(turns: DataFrame) -> DataFrame:
    """Runs in document space: page runs shifted by where their page starts."""
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    starts = asm.explode_pages(asm.assemble_documents(pages)).select(
        F.col("doc_id").alias("conv_id"), (F.col("page") - 1).alias("turn"), F.col("char_start").alias("_delta")
    )
    # A page meets its start as text: its runs are many times larger.
    runs = gm.char_runs(_chars(turns.join(starts, ["conv_id", "turn"]), "_delta"), keep=["_delta"])
    return gm.shift_runs(runs, F.col("_delta")).drop("_delta")


def _spans(turns: DataFrame) -> DataFrame:
    """A citation of sixty characters every ninety-seven, throughout the document."""
    size = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum(F.char_length("text") + 2).alias("n"))
    at = F.posexplode(F.sequence(F.lit(0), F.col("n") - 2, F.lit(97).cast("bigint"))).alias("ref_no", "char_start")
    return size.select("doc_id", at).select(
        "doc_id", F.col("ref_no").cast("bigint").alias("ref_no"), F.col("char_start").cast("int").alias("char_start"), (F.col("char_start") + 60).cast("int").alias("char_end")
    )


_SPANS_SQL = """
sz AS (SELECT conv_id AS doc_id, sum(length(text) + 2)::BIGINT AS n FROM conversations GROUP BY conv_id),
spn AS (SELECT doc_id, unnest(range(0, n - 1, 97))::INTEGER AS s FROM sz),
sp AS (SELECT doc_id, (s // 97)::BIGINT AS ref_no, s, s + 60 AS e FROM spn)
"""


def citation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    boxes = gm.citation_boxes(_spans(turns), _document_runs(turns))
    return boxes.select(
        "doc_id", "ref_no", "page", "covered_from", F.col("left"), "top", F.round("width", 6).alias("width"), F.round("height", 6).alias("height")
    )


CITATION_BOXES = f"""WITH {_CHARS_SQL}, {_SPANS_SQL},
ps AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM conversations),
gc AS (SELECT rn.*, (idx + d)::INTEGER AS pos FROM rn JOIN ps USING (doc_id, page))
SELECT gc.doc_id, ref_no, page, min(pos) AS covered_from, arg_min(x0, pos) AS "left", any_value(top) AS top, round(arg_max(x1, pos) - arg_min(x0, pos), 6) AS width,
  round(any_value(bottom) - any_value(top), 6) AS height
FROM gc JOIN sp ON sp.doc_id = gc.doc_id AND pos >= s AND pos < e GROUP BY gc.doc_id, ref_no, page, run"""


def distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation is made three times, by later and later claims."""
    spans = _spans(table(spark, sf_dir, "conversations"))
    again = spans.select("doc_id", "char_start", "char_end", F.explode(F.array(F.col("ref_no") + 5000, "ref_no", F.col("ref_no") + 900)).alias("ref_no"))
    return gm.distinct_spans(again.withColumn("claim", F.concat(F.lit("c"), F.col("ref_no").cast("string"))))


DISTINCT_SPANS = f"WITH {_SPANS_SQL} SELECT doc_id, s AS char_start, e AS char_end, ref_no, 'c' || ref_no AS claim FROM sp"


def _measured(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("conv_id") + F.col("turn")
    pages = turns.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        (F.col("conv_id") % 6 != 0).alias("is_measured"),
        (n % 5 == 0).alias("from_ocr"),
        n.alias("_n"),
    )
    boxed = pages.where((F.col("_n") % 5 != 0) & (F.col("_n") % 4 != 0))
    return pages, boxed.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))


def overlay_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, measured = _measured(table(spark, sf_dir, "conversations"))
    rendered = pages.select(
        "doc_id",
        "page",
        F.when(F.col("_n") % 3 == 0, 595.5).otherwise(594.0).alias("width"),
        F.lit(842.25).alias("height"),
        F.when(F.col("_n") % 9 == 0, -90).otherwise(720).alias("rotation"),
    )
    return gm.overlay_gap(pages.drop("_n"), measured, rendered).select("doc_id", "page", "gap")


OVERLAY_GAP = """WITH p AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, conv_id % 6 AS m, conv_id + turn AS n FROM conversations)
SELECT doc_id, page, CASE WHEN m = 0 THEN 'not_measured' WHEN n % 5 = 0 THEN 'from_ocr' WHEN n % 4 = 0 THEN 'unverified' WHEN n % 9 = 0 OR n % 3 <> 0 THEN 'page_mismatch' END AS gap FROM p"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, measured = _measured(table(spark, sf_dir, "conversations"))
    docs = pages.groupBy("doc_id").agg(F.first("is_measured").alias("is_measured"), F.count(F.lit(1)).alias("page_count"))
    return gm.coverage(docs, measured)


COVERAGE = """WITH d AS (SELECT conv_id AS doc_id, count(*) AS page_count, count(*) FILTER ((conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 4 <> 0) AS pages_measured FROM conversations GROUP BY conv_id)
SELECT doc_id, pages_measured, page_count, CASE WHEN doc_id % 6 = 0 OR pages_measured = 0 THEN 'No measured positions'
  WHEN pages_measured = page_count AND page_count = 1 THEN 'Positions measured' WHEN pages_measured = page_count THEN 'All pages measured'
  ELSE pages_measured || ' of ' || page_count || ' pages measured' END AS note FROM d"""

QUERIES = {
    "clamp_boxes": clamp_boxes,
    "page_rows": page_rows,
    "page_bands": page_bands,
    "reading_order": reading_order,
    "text_in_order": text_in_order,
    "char_runs": char_runs,
    "remap_runs": remap_runs,
    "trusted_geometry": trusted_geometry,
    "citation_boxes": citation_boxes,
    "distinct_spans": distinct_spans,
    "overlay_gap": overlay_gap,
    "coverage": coverage,
}
ORACLES = {
    "clamp_boxes": CLAMP_BOXES,
    "page_rows": PAGE_ROWS,
    "page_bands": PAGE_BANDS,
    "reading_order": READING_ORDER,
    "text_in_order": TEXT_IN_ORDER,
    "char_runs": CHAR_RUNS,
    "remap_runs": REMAP_RUNS,
    "trusted_geometry": TRUSTED_GEOMETRY,
    "citation_boxes": CITATION_BOXES,
    "distinct_spans": DISTINCT_SPANS,
    "overlay_gap": OVERLAY_GAP,
    "coverage": COVERAGE,
}
