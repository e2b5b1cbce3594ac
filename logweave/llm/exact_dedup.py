"""Exact deduplication against a persistent index of text digests.

The index is bucketed and sorted by digest, so that it joins by sort-merge without being shuffled.
It holds a first row for each distinct text ever seen, and a row for each later batch that had
the text again, with the batch's number of copies.  A batch of documents is reduced to one row per
digest before it meets the index.  What the anti-join leaves is new: the batch's own row stays;
the rest is known, and stays with the index's row.  Both are appended in one write.

All of it is DataFrame and SQL work.  Texts are read once and not shuffled.  A digest that many
rows share costs one row per task in the grouping; to bring a group's result back to its rows,
digests that hold at least a ``1 / HOT_SHARE`` part of all rows (so at most ``HOT_SHARE`` of
them) are broadcast, and the rest, none of them large, is joined by a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import attach_groups, chosen_documents, text_digest
from logweave.session import materialize, scratch_path


class DigestIndex:
    """Rows of digest, keep_id, group_size (copies in one batch) and whether it is the text's first row.

    The folder outlives the session; open it again with the same number of buckets.  An append
    is one Spark write job: if it fails, nothing of it is seen.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT, first BOOLEAN) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def totals(self) -> DataFrame:
        """One row per distinct text: digest, keep_id of the row that stays, copies so far (not shuffled)."""
        keep = F.max(F.when(F.col("first"), F.struct("keep_id"))).getField("keep_id")
        return self.rows().groupBy("digest").agg(keep.alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest is not in the index (sort-merge anti-join)."""
        return groups.hint("merge").join(self.rows().filter("first").select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Write a batch's digest, keep_id, group_size and first."""
        (
            groups.select("digest", "keep_id", "group_size", "first")
            .repartition(self.buckets, "digest")
            .write.insertInto(self.table)
        )


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, digest and a number of the row, written once so that the numbers stay the same."""
    return materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_digest().alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest; the row with the largest doc_id stays."""
    last = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size")).select(
        "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"
    )


def dedup(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate a batch against itself and the index, and append what is new to the index.

    Texts are equal when they are identical; null counts as empty.  Of equal texts in the batch
    the row with the largest doc_id stays; a null doc_id counts as smallest, and of repeated rows
    (same doc_id and text) one stays.  A text that the index already holds stays with the index's
    keep_id and no row of the batch is kept; its group_size counts earlier batches too.

    Returns doc_id, keep_id, group_size, kept, text_sha256 per row; other columns are not read.
    An empty table gives an empty result.
    """
    rows = digests(documents)
    groups = materialize(group_digests(rows), "digest-groups")
    total = rows.count()
    # One row per digest on either side: no key is hot here.
    new = index.unseen(groups).withColumn("copies", F.col("group_size")).withColumn("first", F.lit(True))
    known = (
        groups.select("digest", F.col("group_size").alias("copies"))
        .hint("merge")
        .join(index.totals(), "digest")
        .select(
            "digest",
            "keep_id",
            F.lit(None).cast("long").alias("keep_row"),
            (F.col("group_size") + F.col("copies")).alias("group_size"),
            "copies",
            F.lit(False).alias("first"),
        )
    )
    resolved = materialize(new.unionByName(known), "digest-resolved")
    index.append(resolved.select("digest", "keep_id", F.col("copies").alias("group_size"), "first"))
    resolved = resolved.select("digest", "keep_id", "keep_row", "group_size")
    return attach_groups(rows, resolved, "digest", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup_documents(documents: DataFrame) -> DataFrame:
    """``dedup`` against a new, empty index in the shared folder."""
    spark = documents.sparkSession
    return dedup(documents, DigestIndex(spark, scratch_path(spark, "digest-index")))


def distinct_documents(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of repeated rows one stays."""
    found = dedup_documents(documents)
    stay = found.groupBy("doc_id", F.col("text_sha256").alias("digest")).agg(
        F.max("kept").alias("kept"), F.count("*").alias("rows")
    )
    return chosen_documents(documents, stay.filter("kept"))
