"""Stored postings: texts are tokenised when documents come, requests read tokens only.

A store holds, per batch of documents added, the documents' ids, their postings and the document
frequencies of their tokens. Postings lie in folders by a hash of the token, in files that are ranges of
(token, document), so a token that every document holds is spread over files like any other. A
request reads only the folders its tokens fall in. A batch of new documents is a small delta beside the
first, large one; frequencies of all batches are added up for the tokens asked for. Removed documents are
kept as a list of ids, with what their tokens counted, until :func:`compact` rewrites the store.

Writing a batch again replaces it, so a retried load changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemark.operators.joins import small_side
from sourcemark.operators.retrieval import postings, ranked
from sourcemark.session import settle

# Folders that tokens are dealt over.
SHARDS = 64


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int")


class PostingStore:
    """Postings below ``path``; ``scope`` are columns of the documents that a request is limited to.

    ``doc_type`` and ``scope`` fix the schemas, so reading never looks into files for them.
    """

    def __init__(self, spark: SparkSession, path: str, scope: Sequence[str] = (), doc_type: str = "bigint", shards: int = SHARDS):
        self.spark, self.path, self.scope, self.shards = spark, path.rstrip("/"), list(scope), shards
        keys = [f"{c} string" for c in self.scope]
        self.schemas = {
            "documents": ", ".join([*keys, f"doc_id {doc_type}", "batch bigint"]),
            "removed": f"doc_id {doc_type}, batch bigint",
            "postings": ", ".join([*keys, f"doc_id {doc_type}", "token string", "batch bigint", "shard int"]),
            "frequencies": ", ".join([*keys, "token string", "df bigint", "batch bigint", "shard int"]),
        }

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        """One batch's part of a table, instead of what the same batch wrote before."""
        where = f"{self.path}/{name}/batch={batch}"
        if "shard" not in rows.columns:
            rows.write.mode("overwrite").parquet(where)
            return
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [c for c in ("shard", "token", "doc_id") if c in rows.columns]
        ordered = rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
        ordered.write.mode("overwrite").partitionBy("shard").parquet(where)

    def create(self) -> "PostingStore":
        """An empty store, if there is none."""
        for name, schema in self.schemas.items():
            empty = self.spark.createDataFrame([], schema).drop("batch", "shard")
            empty.write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1" + ("/shard=-1" if "shard" in schema else ""))
        return self

    def add(self, docs: DataFrame, batch: int) -> None:
        """Documents (scope, doc_id, text) as batch ``batch``; ids that the store has not seen."""
        posted = postings(docs, self.scope).withColumn("shard", _shard(self.shards))
        self._write(posted, "postings", batch)
        own = self._read("postings").where(F.col("batch") == batch)
        counts = own.groupBy(*self.scope, "token").agg(F.count(F.lit(1)).alias("df")).withColumn("shard", _shard(self.shards))
        self._write(counts, "frequencies", batch)
        # Last: a document is there once all its tokens are.
        self._write(docs.select(*self.scope, "doc_id"), "documents", batch)

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Documents (doc_id) to leave out from now on; their tokens no longer count."""
        gone = small_side(self.documents().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id"))
        lost = self._read("postings").join(gone, "doc_id", "left_semi")
        counts = lost.groupBy(*self.scope, "token").agg((-F.count(F.lit(1))).alias("df")).withColumn("shard", _shard(self.shards))
        self._write(counts, "frequencies", batch)
        self._write(gone, "removed", batch)

    def documents(self) -> DataFrame:
        """(scope, doc_id) of all documents of the store."""
        gone = small_side(self._read("removed").select("doc_id"))
        return self._read("documents").select(*self.scope, "doc_id").join(gone, "doc_id", "left_anti")

    def asked(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and frequencies of the tokens ``wanted`` (scope, token), from their folders alone."""
        numbers = [r[0] for r in wanted.select(_shard(self.shards).alias("s")).distinct().collect()]
        here = F.col("shard").isin(numbers) if numbers else F.lit(False)
        by = [*self.scope, "token"]
        gone = small_side(self._read("removed").select("doc_id"))
        hits = self._read("postings").where(here).select(*self.scope, "doc_id", "token").join(wanted, by)
        counts = self._read("frequencies").where(here).join(wanted, by).groupBy(*by).agg(F.sum("df").alias("df"))
        return hits.join(gone, "doc_id", "left_anti"), counts.where(F.col("df") > 0)

    def retrieve(self, terms: DataFrame, digits: int | None = None) -> DataFrame:
        """As :func:`retrieval.retrieve` over the documents of the store; no text is read."""
        return ranked(terms, self.documents(), self.asked, self.scope, digits)

    def compact(self, path: str, batch: int = 0) -> "PostingStore":
        """All batches as one in a new store at ``path``, without the removed documents."""
        new = PostingStore(self.spark, path, self.scope, self.spark.createDataFrame([], self.schemas["removed"]).dtypes[0][1], self.shards)
        new.create()
        gone = small_side(self._read("removed").select("doc_id"))
        new._write(self._read("postings").drop("batch").join(gone, "doc_id", "left_anti"), "postings", batch)
        counts = self._read("frequencies").groupBy(*self.scope, "token", "shard").agg(F.sum("df").alias("df"))
        new._write(counts.where(F.col("df") > 0), "frequencies", batch)
        new._write(settle(self.documents()), "documents", batch)
        return new
