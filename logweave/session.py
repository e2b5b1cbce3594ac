"""Session helpers: shared scratch tables, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Largest lookup table that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's shared checkpoint folder.

    Only a local master without the setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="logweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores where its files give fewer tasks than there are cores.

    A scan with enough splits is left alone, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize_sized(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``materialize``, with the size of the table's text form measured while it is written."""
    size = Observation()
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    path = scratch_path(df.sparkSession, label)
    df.observe(size, F.sum(row_bytes).alias("bytes")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), size.get["bytes"] or 0


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join many rows to a lookup table, also where one key holds most of the rows.

    The lookup is written first, so that its size is known.  Up to ``broadcast_bytes`` it is
    broadcast and the rows are not shuffled.  Beyond, both sides are shuffled by the keys, and
    adaptive execution splits the partitions of hot keys; nothing is repeated beforehand.
    """
    lookup, size = materialize_sized(lookup, "lookup")
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), keys, how)
    return rows.join(lookup.hint("merge"), keys, how)
