"""Pages (or blocks) of text into documents with one offset space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcemark.functions import text as tx

# What joins pages, and how much text makes a page more than an image.
PAGE_SEPARATOR = "\n\n"
MIN_PAGE_CHARS = 20
# Pages of one document worth recognising, and the mean confidence required.
RECOGNITION_PAGES = 10
RECOGNITION_CONFIDENCE = 75.0


def lacks_text(text: Column) -> Column:
    return F.char_length(tx.strip(text)) < MIN_PAGE_CHARS


def clean_page(text: Column) -> Column:
    """Normalise, then drop U+0000: offsets are measured on what is left."""
    return F.replace(tx.nfc(text), F.lit("\x00"), F.lit(""))


def assemble_documents(pages: DataFrame, has_images: str | None = None) -> DataFrame:
    """Rows (doc_id, page, text[, from_ocr][, image flag]) → one document per doc_id.

    A document is one string cell, so its pages fit in one row by construction; the page
    texts are gathered once and the boundaries are read off the same array.
    """
    image = F.col(has_images) if has_images else F.lit(False)
    from_ocr = F.col("from_ocr") if "from_ocr" in pages.columns else F.lit(False)
    cleaned = pages.select(
        "doc_id",
        F.col("page").cast("int").alias("page"),
        clean_page(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        from_ocr.alias("ocr"),
        image.alias("image"),
    )
    # The window and the aggregate below need the same hash partitioning: one shuffle.
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("text")
    placed = (
        cleaned.withColumn(
            "start", F.coalesce(F.sum(size + len(PAGE_SEPARATOR)).over(before), F.lit(0)).cast("int")
        )
        .withColumn("end", (F.col("start") + size).cast("int"))
        .withColumn("bare", lacks_text(F.col("text")))
    )
    gathered = placed.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text", "start", "end", "bare", "ocr"))).alias(
            "_pages"
        ),
        F.bool_or("image").alias("_image"),
    )
    spans = F.transform(
        "_pages",
        lambda page: F.struct(
            page["page"].alias("page_number"),
            page["start"].alias("char_start"),
            page["end"].alias("char_end"),
        ),
    )

    def numbers(flag: str) -> Column:
        return F.transform(F.filter(F.col("_pages"), lambda p: p[flag]), lambda p: p["page"])

    document = gathered.select(
        "doc_id",
        F.array_join(F.transform("_pages", lambda p: p["text"]), PAGE_SEPARATOR).alias("text"),
        spans.alias("pages"),
        numbers("bare").alias("pages_without_text"),
        numbers("ocr").alias("pages_from_ocr"),
        F.size("_pages").alias("page_count"),
        F.col("_image").alias("has_images"),
    )
    return with_outcome(document)


def with_outcome(documents: DataFrame) -> DataFrame:
    """What became of the document: readable, partially scanned, unreadable or empty."""
    bare = F.size("pages_without_text")
    recognised = F.size("pages_from_ocr") > 0
    outcome = (
        F.when((bare == F.col("page_count")) & F.col("has_images"), "no_text_layer")
        .when(bare == F.col("page_count"), "empty")
        .when(bare > 0, "partially_scanned")
        .otherwise("ok")
    )
    return documents.withColumn("outcome", outcome).withColumn("used_ocr", recognised)


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence over rows that are words (non-blank, not marked -1); 0 without any."""
    is_word = (F.col("conf") >= 0) & (tx.strip(F.col("text")) != "")
    return words.groupBy("doc_id", "page").agg(
        F.coalesce(F.avg(F.when(is_word, F.col("conf"))), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(is_word).alias("words"),
    )


def gate_recognised(
    recognised: DataFrame, words: DataFrame, minimum: float = RECOGNITION_CONFIDENCE
) -> DataFrame:
    """Blank the recognised text of pages read with too little confidence (0 = no gate)."""
    scored = recognised.join(page_confidence(words).drop("words"), ["doc_id", "page"], "left")
    refused = (F.lit(minimum) > 0) & (F.coalesce(F.col("mean_confidence"), F.lit(0.0)) < minimum)
    text = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    return scored.withColumn("text", F.when(refused, F.lit("")).otherwise(text)).withColumn(
        "refused", refused
    )


def merge_recognised(
    pages: DataFrame, recognised: DataFrame, max_pages: int = RECOGNITION_PAGES
) -> DataFrame:
    """Fill pages without text from recognised ones, within the page budget per document.

    The first ``max_pages`` eligible pages in page order spend the budget whether or not
    recognition gave anything. A page is replaced only by text that clears the same bar.
    Pages of one document fit one row, so the window group is bounded.
    """
    eligible = lacks_text(F.coalesce(F.col("text"), F.lit(""))) & F.col("has_image")
    in_order = Window.partitionBy("doc_id").orderBy("page")
    turn = F.sum(F.col("_eligible").cast("int")).over(in_order)
    offered = recognised.select("doc_id", "page", F.col("text").alias("_read"))
    usable = (
        F.col("_eligible")
        & (F.col("_turn") <= max_pages)
        & F.col("_read").isNotNull()
        & ~lacks_text(F.coalesce(F.col("_read"), F.lit("")))
    )
    return (
        pages.withColumn("_eligible", eligible)
        .withColumn("_turn", turn)
        .join(offered, ["doc_id", "page"], "left")
        .withColumn("from_ocr", usable)
        .withColumn("over_budget", F.col("_eligible") & (F.col("_turn") > max_pages))
        .withColumn("text", F.when(F.col("from_ocr"), F.col("_read")).otherwise(F.col("text")))
        .drop("_eligible", "_turn", "_read")
    )


def quality_sweep(pages: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """Per variant: known lines read correctly, visible characters, mean word confidence.

    ``pages`` (variant, doc_id, page, text), ``words`` (variant, conf, text), ``known``
    (doc_id, page, line): the known lines of a page meet that page only, by equality.
    """
    read = pages.join(
        known.groupBy("doc_id", "page").agg(F.collect_list("line").alias("_lines")),
        ["doc_id", "page"],
        "left",
    )
    lines = F.coalesce(F.col("_lines"), F.array().cast("array<string>"))
    scored = read.groupBy("variant").agg(
        F.sum(F.size(F.filter(lines, lambda line: F.contains(F.col("text"), line)))).alias("lines_found"),
        F.sum(F.size(lines)).alias("lines_known"),
        F.sum(F.char_length(tx.strip(F.col("text")))).alias("chars"),
    )
    is_word = (F.col("conf") >= 0) & (tx.strip(F.col("text")) != "")
    trust = words.groupBy("variant").agg(
        F.coalesce(F.avg(F.when(is_word, F.col("conf"))), F.lit(0.0)).alias("mean_confidence")
    )
    return scored.join(trust, "variant", "left").withColumn(
        "mean_confidence", F.coalesce(F.col("mean_confidence"), F.lit(0.0))
    )


def explode_pages(documents: DataFrame) -> DataFrame:
    """Page rows cut out of the document text by its stored boundaries."""
    return documents.select("doc_id", "text", F.inline("pages")).select(
        "doc_id",
        F.col("page_number").alias("page"),
        "char_start",
        "char_end",
        F.substr(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias(
            "text"
        ),
    )


def nest_pages(rows: DataFrame) -> DataFrame:
    """Boundary rows back to one ordered array per document."""
    return rows.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("page").alias("page_number"), "char_start", "char_end"))
        ).alias("pages")
    )


def pages_of_offsets(documents: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset) → page, clamping below the first and above the last page."""
    from sourcemark.operators.evidence import page_of
    from sourcemark.operators.joins import attach

    placed = attach(offsets, documents.select("doc_id", "pages"), ["doc_id"], "left")
    return placed.withColumn("page", page_of(F.col("pages"), F.col("offset"))).drop("pages")


def assemble_blocks(cells: DataFrame) -> DataFrame:
    """Paragraphs and table rows, in declared order, into a one-page document.

    ``cells`` (doc_id, block, row, cell, is_table, text): a paragraph is a block of one cell
    and keeps its text; the cells of a table row are stripped and joined by tabs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ready = cells.withColumn("text", F.when(F.col("is_table"), tx.strip(text)).otherwise(text))
    rows = ready.groupBy("doc_id", "block", "row").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]
            ),
            "\t",
        ).alias("line")
    )
    pages = rows.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("block", "row", "line"))), lambda r: r["line"]
            ),
            "\n",
        ).alias("text")
    )
    return assemble_documents(pages.withColumn("page", F.lit(1)))
