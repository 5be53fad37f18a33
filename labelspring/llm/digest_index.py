"""Exact deduplication with a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest.  A new
batch is reduced to one row per digest, anti-joined with the index by sort-merge
on the buckets, and what is new is appended.  The index side of that join never
moves; only digests of the batch do, and copies are counted before the shuffle.

Defined cases: a null text is empty, and all empty texts are equal.  The smallest
doc_id of a group stays; null ids come last, a group of null ids only has a null
keep_id.  Equal rows with the same id are all marked kept in the decisions,
``deduplicate`` lets one of them through.  An empty batch adds nothing.  Other
columns are ignored by the index and kept by ``deduplicate``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.llm.common import whole_text, without, written
from labelspring.runtime import scratch_path

WHITE = r"[\x20\x09-\x0D]+"
# A digest with at least this share of a batch is hot; there are at most its inverse of them.
HOT_SHARE = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the SHA-256 of the text with every white-space run as one space."""
    text = F.regexp_replace("text", WHITE, " ")
    return whole_text(docs, hashed=True).select(
        "doc_id", "text_hash", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )


class DigestIndex:
    """``name`` is a table of the session's catalog; its files lie in ``path`` (the shared folder)."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digest_index")
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], "digest binary, keep_id long"))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch and return doc_id, text_hash, digest, keep_id, group_size (copies in the batch)."""
        rows = written(digests(docs), "digests")
        groups = written(
            rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups"
        )
        known = self.table().select("digest")
        new = groups.select("digest", F.col("first_id").alias("keep_id"))
        self._append(new.join(known.hint("merge"), "digest", "left_anti"))
        sized = written(
            groups.select("digest", "group_size").join(self.table().hint("merge"), "digest"), "sized_groups"
        )
        return self._spread(rows, sized)

    def _spread(self, rows: DataFrame, sized: DataFrame) -> DataFrame:
        """Give every row its group; hot groups by a broadcast of at most 1 / HOT_SHARE rows."""
        total = rows.count()
        hot = F.col("group_size") >= max(2, int(total * HOT_SHARE) + 1)
        few = F.broadcast(sized.where(hot))
        rest = sized.where(~hot)
        names = ["doc_id", "text_hash", "digest", "keep_id", "group_size"]
        of_hot = rows.join(few, "digest").select(names)
        others = rows.join(F.broadcast(sized.where(hot).select("digest")), "digest", "left_anti")
        return of_hot.unionByName(others.join(rest, "digest").select(names))


def found(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    return (index or DigestIndex(docs.sparkSession)).add(docs).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )


def decisions(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return found(docs, index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each digest."""
    rows = written(found(docs, index).select("doc_id", "text_hash", "digest", "kept"), "decisions")
    gone = rows.where(~F.col("kept")).select("doc_id", "text_hash")
    twice = rows.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"))
    twice = written(twice.where("n > 1"), "again")
    # rows of one id and digest with other white space
    least = twice.select(F.col("doc_id").alias("id"), "digest", F.col("text_hash").alias("least"))
    other = rows.where("kept").join(least, "digest").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") != F.col("least")))
    gone = written(gone.unionByName(other.select("doc_id", "text_hash")), "all_gone")
    return without(docs, gone, twice.select("doc_id", "text_hash"))
