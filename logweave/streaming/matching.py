"""Log lines that keep arriving: parsed and matched to a known catalogue.

The column expressions of the batch operators work on streams as they are.  What differs
is that a stream is never grouped: each line meets the catalogue by itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.formats import LogFormat, get_format
from logweave.operators.parsing import parse_lines
from logweave.operators.templates import masked_lines, match_catalogue
from logweave.sources.lines import path_below


def read_line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(log_id, line)`` for text files as they appear in a folder; ``log_id`` is the path below it."""
    return spark.readStream.text(folder).select(
        path_below(F.col("_metadata.file_path"), [folder]).alias("log_id"), F.col("value").alias("line")
    )


def parse_stream(lines: DataFrame, fmt: str | LogFormat, masks: Iterable[str] | None = None) -> DataFrame:
    """Parsed and masked lines of a stream."""
    fmt = get_format(fmt)
    return masked_lines(parse_lines(lines, fmt), fmt.masks if masks is None else masks)


def match_stream(
    masked: DataFrame, catalogue: DataFrame, st: float, path: str, checkpoint: str
) -> StreamingQuery:
    """Append each line with its event to a parquet table, micro-batch by micro-batch.

    A batch is written under its own number, so a batch that runs again after a failure
    replaces its earlier output.  Lines without an event keep a null ``EventId``.
    """

    def match(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("line_no", F.monotonically_increasing_id())
        matched = match_catalogue(rows, catalogue, st).drop("line_no")
        matched.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        masked.writeStream.foreachBatch(match)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
