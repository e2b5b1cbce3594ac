"""Lines to typed columns, rejected lines, coverage, first and last line, line sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.formats import LogFormat, get_format
from logweave.functions.text import header_fields, joined_headers, matches_format, strip
from logweave.sources.lines import contiguous_ids


def extract_fields(
    lines: DataFrame, per_format: Callable[[Callable[[LogFormat], Column]], Column]
) -> DataFrame:
    """Replace ``line`` by the array ``_fields`` and drop the lines that do not match.

    ``per_format`` turns an expression for one format into the expression for a row.  The
    first regular-expression pass goes through a one-row generator: Spark evaluates it once
    per line, and does not copy it into the filter and every header column.
    """
    kept = [c for c in lines.columns if c != "line"]
    text = F.col("_text")
    fast = per_format(lambda fmt: joined_headers(text, fmt, fmt.fast_regex))
    return (
        lines.select(*kept, strip(F.col("line")).alias("_text"))
        .select(*kept, "_text", F.explode(F.array(fast)).alias("_fast"))
        .select(*kept, per_format(lambda fmt: header_fields(text, F.col("_fast"), fmt)).alias("_fields"))
        .filter(F.col("_fields").isNotNull())
    )


def parse_lines(lines: DataFrame, fmt: str | LogFormat) -> DataFrame:
    """One string column per header for the lines that match; the others are left out.

    Keeps every column of ``lines`` except ``line`` itself.  A header in an optional part
    is null where the part is absent.
    """
    fmt = get_format(fmt)
    fields = extract_fields(lines, lambda build: build(fmt))

    def header(position: int, name: str) -> Column:
        value = F.col("_fields")[position]
        return (F.nullif(value, F.lit("")) if name in fmt.optional_headers else value).alias(name)

    kept = [c for c in fields.columns if c != "_fields"]
    return fields.select(*kept, *[header(i, name) for i, name in enumerate(fmt.headers)])


def rejected_lines(lines: DataFrame, fmt: str | LogFormat) -> DataFrame:
    return lines.filter(~matches_format(F.col("line"), get_format(fmt)))


def with_line_ids(parsed: DataFrame) -> DataFrame:
    """``LineId``: 1, 2, 3 … per log over the lines that parsed."""
    return contiguous_ids(parsed, "log_id", "line_no", "LineId")


def coverage(lines: DataFrame, fmt: str | LogFormat) -> DataFrame:
    """Lines, parsed lines and their ratio per log."""
    counts = lines.groupBy("log_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(matches_format(F.col("line"), get_format(fmt))).alias("n_parsed"),
    )
    return counts.withColumn("coverage", F.col("n_parsed") / F.col("n_lines"))


def log_extent(lines: DataFrame) -> DataFrame:
    """First line, last line and number of lines per log."""
    return lines.groupBy("log_id").agg(
        strip(F.min_by("line", "line_no")).alias("first_line"),
        strip(F.max_by("line", "line_no")).alias("last_line"),
        F.count("*").alias("n_lines"),
    )


def sample_lines(lines: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """``k`` lines per log, each line equally likely, the same ones for the same seed.

    The top-k filter is applied before the shuffle as well, so a log of any size sends at
    most ``k`` lines per task.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "log_id", F.col("line_no").cast("string")))
    order = W.partitionBy("log_id").orderBy("_draw", "line_no")
    return (
        lines.withColumn("_draw", draw)
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= k)
        .drop("_draw", "_place")
    )
