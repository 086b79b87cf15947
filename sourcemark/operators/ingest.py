"""Admission, deduplication, retention and checks of incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.functions import text as tx
from sourcemark.operators.joins import attach
from sourcemark.operators.ordered import number_within

# Accepted suffixes with the bytes such a file starts with, and the size limit.
MAGIC = {".pdf": "255044462D", ".docx": "504B0304"}
MAX_BYTES = 10 * 1024 * 1024
# Limits of a job's requirements.
MAX_LABEL = 300
MAX_DETAIL = 2000
MAX_WEIGHT = 100.0
MAX_REQUIREMENTS = 30


def suffix_of(path: Column) -> Column:
    """The lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(?s)(\.[^.]*)\z", 1))


def admit(
    files: DataFrame, magic: dict[str, str] | None = None, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Files (path, length, content, consent) with ``reason``; null = admitted. First check to fail wins.

    Only the leading bytes of ``content`` are looked at. ``magic``: suffix → hex prefix.
    """
    magic = MAGIC if magic is None else magic
    suffix = F.col("suffix")
    starts = F.lit(False)
    for name, prefix in magic.items():
        head = F.hex(F.substring(F.col("content"), 1, len(prefix) // 2))
        starts = starts | ((suffix == name) & (head == prefix.upper()))
    reason = (
        F.when(~F.coalesce(F.col("consent"), F.lit(False)), "no_consent")
        .when(~suffix.isin(*magic), "unsupported_type")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too_large")
        .when(~starts, "magic_mismatch")
    )
    return files.withColumn("suffix", suffix_of(F.col("path"))).withColumn("reason", reason)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedupe_uploads(
    uploads: DataFrame, existing: DataFrame, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(uploads kept, uploads answered by another row), keyed by (owner_id, content_hash).

    The first arrival keeps its row and everything stamped on it. Deciding is one aggregate
    with map-side combine, so a file uploaded by half the world is no hot spot; the content
    itself never takes part.
    """
    key = ["owner_id", "content_hash"]
    known = existing.select(*key, F.col("upload_id").alias("kept_id")).withColumn("_old", F.lit(True))
    first = uploads.groupBy(*key).agg(
        F.min_by("upload_id", F.struct(*order)).alias("_first")
    )
    winners = (
        first.join(known, key, "left")
        .withColumn("kept_id", F.coalesce(F.col("kept_id"), F.col("_first")))
        .select(*key, "kept_id")
    )
    # Every copy is matched with its winner; copies of one file are dealt over many tasks.
    answered = attach(uploads, winners, key, "inner")
    kept = answered.where(F.col("upload_id") == F.col("kept_id")).drop("kept_id")
    return kept, answered.where(F.col("upload_id") != F.col("kept_id"))


def purge_expired(rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows past their ``expires_at``); the moment itself is not past."""
    expired = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return rows.where(~expired), rows.where(expired)


def check_requirements(rows: DataFrame) -> DataFrame:
    """Requirement rows with ``reason``; null = accepted. Blank labels are dropped first.

    ``nth`` counts the non-blank requirements of a job in position order (null for blank
    ones): the limit refuses the rows beyond it. Refused rows are returned like the others.
    """
    blank = tx.strip(F.coalesce(F.col("label"), F.lit(""))) == ""
    labelled = number_within(rows.where(~blank), ["job_id"], [F.col("position"), F.col("id")], "nth")
    refused = labelled.withColumn(
        "reason",
        F.when(F.char_length("label") > MAX_LABEL, "label_too_long")
        .when(F.char_length("detail") > MAX_DETAIL, "detail_too_long")
        .when(~F.coalesce((F.col("weight") > 0) & (F.col("weight") <= MAX_WEIGHT), F.lit(False)), "bad_weight")
        .when(F.col("nth") > MAX_REQUIREMENTS, "too_many"),
    )
    return refused.unionByName(
        rows.where(blank).withColumn("reason", F.lit("blank_label")), allowMissingColumns=True
    )
