"""Which of the known formats a log follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.formats import FORMATS, JAVA_FLAGS, LogFormat
from logweave.functions.text import matches_format, strip
from logweave.operators.parsing import extract_fields, sample_lines
from logweave.session import lookup_join, materialize


def format_scores(lines: DataFrame) -> DataFrame:
    """``(log_id, format, n_strict, n_lines, format_rank)`` over the given lines.

    All formats are tested in one pass, as one conditional count each, and the counts are
    turned into rows after the aggregation.
    """
    text = strip(F.col("line"))
    counts = lines.groupBy("log_id").agg(
        F.count("*").alias("n_lines"),
        *[F.count_if(text.rlike(JAVA_FLAGS + fmt.strict_regex)).alias(fmt.name) for fmt in FORMATS],
    )
    scores = F.explode(
        F.array(*[
            F.struct(
                F.lit(fmt.name).alias("format"),
                F.col(fmt.name).alias("n_strict"),
                F.lit(fmt.required_literal_length).alias("literals"),
                F.lit(position).alias("position"),
            )
            for position, fmt in enumerate(FORMATS)
        ])
    )
    best = W.partitionBy("log_id").orderBy(F.desc("n_strict"), F.desc("literals"), "position")
    return (
        counts.select("log_id", "n_lines", scores.alias("s"))
        .select("log_id", "n_lines", "s.*")
        .withColumn("format_rank", F.row_number().over(best))
        .select("log_id", "format", "n_strict", "n_lines", F.col("format_rank").cast("bigint").alias("format_rank"))
    )


def candidate_formats(lines: DataFrame, k: int = 10, tries: int = 3, seed: int = 0) -> DataFrame:
    """The best-scoring formats per log on a sample of its lines, best first."""
    return format_scores(sample_lines(lines, k, seed)).filter(
        (F.col("format_rank") <= tries) & (F.col("n_strict") > 0)
    )


def detect_format(lines: DataFrame, k: int = 10, tries: int = 3, seed: int = 0) -> DataFrame:
    """``(log_id, format, n_parsed, n_lines, coverage)``: the candidate with most parsed lines.

    Candidates come from a sample; the choice among them is made on every line of the log.
    """
    candidates = materialize(candidate_formats(lines, k, tries, seed), "candidates")
    names = candidates.groupBy("log_id").agg(F.collect_list("format").alias("_candidates"))
    text = strip(F.col("line"))
    # Only the candidates of a line's own log are tested: AND stops at the cheap first part.
    counts = (
        lookup_join(lines, names, ["log_id"], "inner")
        .groupBy("log_id")
        .agg(
            F.count("*").alias("n_lines"),
            *[
                F.count_if(F.array_contains("_candidates", fmt.name) & matches_format(text, fmt)).alias(fmt.name)
                for fmt in FORMATS
            ],
        )
    )
    per_format = F.explode(F.array(*[
        F.struct(F.lit(fmt.name).alias("format"), F.col(fmt.name).alias("n_parsed")) for fmt in FORMATS
    ]))
    best = W.partitionBy("log_id").orderBy(F.desc("n_parsed"), "format_rank")
    return (
        counts.select("log_id", "n_lines", per_format.alias("c"))
        .select("log_id", "n_lines", "c.*")
        .join(candidates.select("log_id", "format", "format_rank"), ["log_id", "format"])
        .withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") == 1)
        .select("log_id", "format", "n_parsed", "n_lines", (F.col("n_parsed") / F.col("n_lines")).alias("coverage"))
    )


def parse_detected(lines: DataFrame, detected: DataFrame) -> DataFrame:
    """Parse logs of different formats in one scan.

    Gives ``(log_id, line_no, format, headers, content)`` with the headers as a map, for the
    lines that match the format found for their log.
    """
    joined = lookup_join(
        lines.select("log_id", "line_no", "line"),
        detected.select("log_id", "format"),
        ["log_id"],
        "inner",
    )

    def per_format(build: Callable[[LogFormat], Column]) -> Column:
        row = F.lit(None)
        for fmt in reversed(FORMATS):
            row = F.when(F.col("format") == fmt.name, build(fmt)).otherwise(row)
        return row

    names = per_format(lambda fmt: F.array(*map(F.lit, fmt.headers)))
    return extract_fields(joined, per_format).select(
        "log_id",
        "line_no",
        "format",
        F.map_from_arrays(names, F.col("_fields")).alias("headers"),
        F.element_at("_fields", -1).alias("content"),
    )
