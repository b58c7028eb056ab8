"""Exact deduplication against a persistent index of digests, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import lookup_join, partitions, shared_path, stored, table, text_of

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


class DigestIndex:
    """A table of (digest, keep_id), one row per distinct text ever seen, at `location` in shared storage.

    The table is bucketed and sorted by digest, so the anti-join of a new batch reads it without a
    shuffle. A later session gets the same index by giving the same location and bucket count.
    Choose buckets so that one bucket of 40-byte rows fits a task's memory.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None) -> None:
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets or partitions(spark)
        self.name = f"digest_index_{hashlib.md5(self.location.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds the digests that the index lacks; run again after a failure, it adds only what is still missing."""
        fresh = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """All columns of docs, with keep_id, group_size, kept and text_sha256.

        A null text counts as empty. Of equal texts that are new to the index the row with the largest id
        stays; a text that the index holds already has the index's keep_id. group_size counts the
        rows of this batch with that text. Rows that repeat both id and text are the same document
        and share its verdict. A null id ranks below every other. Columns of docs named like a result
        are replaced. The docs are read twice; they are neither cached nor collected.
        """
        docs = docs.drop(*RESULT)
        key = "__rw_digest"
        digest = F.unhex(F.sha2(text_of(text).cast("binary"), 256))
        groups = docs.select(digest.alias("digest"), F.col(doc_id).cast("long").alias("id"))
        groups = stored(groups.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digests")
        self.append(groups)
        known = groups.select("digest", "group_size").join(self.entries(), "digest").withColumnRenamed("digest", key)
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        out = lookup_join(docs.withColumn(key, digest), known, [key], "group_size", total, [doc_id])
        return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))).withColumn("text_sha256", F.lower(F.hex(key))).drop(key)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, dropped ones too; nulls, ties and repeats as in DigestIndex.deduplicate."""
    index = DigestIndex(spark, shared_path(spark, "digest-index"))
    out = index.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
