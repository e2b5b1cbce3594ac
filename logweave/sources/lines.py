"""Text logs as numbered lines, and contiguous numbering without a global sort task."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.session import lookup_join, materialize

# Rows per numbering bucket: bounds the rows any one task sorts.
BUCKET_ROWS = 1 << 20


def _plain_path(path: Column) -> Column:
    """A file's path without scheme and URL escapes."""
    whole = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    return F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))


def path_below(path: Column, roots: list[str]) -> Column:
    """A file's plain path below the root it was read from; its own name where the root is the file."""
    path = _plain_path(path)
    name = path
    for root in roots:
        root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root)
        folder = re.split(r"[*?\[{]", root)[0]
        if folder != root:
            folder = folder[: folder.rfind("/")]
        folder = (folder if folder.startswith("/") else os.path.abspath(folder)).rstrip("/")
        name = (
            F.when(path == F.lit(folder), F.element_at(F.split(path, "/"), -1))
            .when(path.startswith(folder + "/"), F.substring(path, len(folder) + 2, 1 << 30))
            .otherwise(name)
        )
    return name


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(log_id, line_no, line)`` for text files; ``log_id`` is the path below the one that is read.

    Each file split is read by one task in order, so the number of a line is its place in
    the split plus the lines of the file's earlier splits.  The files are read once, into a
    scratch table that keeps each line's split and place: how a later job cuts the files makes no
    difference.  Only one row per split is shuffled.  A line whose split has no offset is an
    error, not a line less.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("line"),
        ),
        "log_lines",
    )
    splits = lines.groupBy("_file", "_start").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_lines")
    )
    before = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_start",
        (F.coalesce(F.sum("_lines").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
    )
    known = F.coalesce("_shift", F.raise_error(F.concat(F.lit("no offset for a split of "), "_file")).cast("bigint"))
    return lookup_join(lines, offsets, ["_file", "_start"], "left").select(
        path_below(F.col("_file"), [path] if isinstance(path, str) else list(path)).alias("log_id"),
        (F.col("_row") + known).alias("line_no"),
        "line",
    )


def contiguous_ids(
    df: DataFrame, key: str, order: str, name: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add 1, 2, 3 … per ``key`` in ``order``, a non-negative whole number unique per key.

    Rows are ranked inside buckets of ``order`` values, which hold at most ``bucket_rows``
    rows each, and bucket totals are summed up: one row per bucket in the final window.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_rows)))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(key, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .select(key, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(key, "_bucket").orderBy(order)
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [key, "_bucket"])
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_bucket", "_rank", "_offset")
    )
