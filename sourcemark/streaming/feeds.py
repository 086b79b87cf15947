"""Streaming twins without timers: delivery and upload deduplication, and streams over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemark.operators.ingest import dedupe_uploads
from sourcemark.operators.joins import small_side
from sourcemark.session import settle
from sourcemark.streaming import timed

UPLOAD_KEY = ["owner_id", "content_hash"]


def stream_dedupe_dispatch(dispatches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One dispatch per (id, attempt) within the watermark delay; state expires with it."""
    return dispatches.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id", "attempt"])


def stream_stalled(updates: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Status updates (id, at, status) → claims not followed by another update in time."""
    marked = updates.withWatermark("at", delay).withColumn("tie", F.lit(0))
    return timed.stream_stalled(marked).where(~F.col("late")).drop("late")


def settle_uploads(batch: DataFrame, batch_id: int, store: str) -> None:
    """One micro-batch of uploads (upload_id, owner_id, content_hash) against everything stored before it.

    The first upload of a file by an owner stays, over all batches; uploads are settled however late they
    come, as the stored table is the state. What a batch writes replaces what the same batch wrote
    before, and it looks at earlier batches only, so a replayed batch adds nothing and changes nothing.
    """
    spark = batch.sparkSession
    rows = settle(batch.select("upload_id", *UPLOAD_KEY))
    earlier = stored_uploads(spark, store, rows).where(F.col("batch") < batch_id)
    # Only what this batch may meet leaves the scan of the store.
    asked = small_side(rows.select(*UPLOAD_KEY).distinct())
    known = earlier.select("upload_id", *UPLOAD_KEY).join(asked, UPLOAD_KEY, "left_semi")
    kept, answered = dedupe_uploads(rows, known, ["upload_id"])
    answered.select("upload_id", *UPLOAD_KEY, "kept_id").write.mode("overwrite").parquet(f"{store}/answered/batch={batch_id}")
    kept.select("upload_id", *UPLOAD_KEY).write.mode("overwrite").parquet(f"{store}/kept/batch={batch_id}")


def stored_uploads(spark: SparkSession, store: str, like: DataFrame, what: str = "kept") -> DataFrame:
    """The stored rows with the batch that brought them; a new store is empty."""
    types = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in ["upload_id", *UPLOAD_KEY])
    schema += f", kept_id {types['upload_id']}" if what == "answered" else ""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/{what}/batch=-1")
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{store}/{what}")


def run_uploads(uploads: DataFrame, store: str, checkpoint: str) -> None:
    """All uploads available now into the store, which belongs to this one checkpoint: its batch ids name the parts."""
    query = (
        uploads.writeStream.foreachBatch(lambda batch, batch_id: settle_uploads(batch, batch_id, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything available now into Parquet files under ``path``, exactly once."""
    timed.use_state_store(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_arrivals(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Files of a folder as a stream, in the order they were written, ``files`` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream, with the schema of the stored one."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, because the table may be one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
