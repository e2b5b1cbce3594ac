"""How well mined events agree with known ones, from counts of pairs of lines.

The two groupings meet in a table of counts, one row per pair of groups that share a line; it is
counted before it is shuffled, and all figures come from it, so no pair of lines is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(lines: DataFrame, true: str, mined: str, keys: list[str]) -> DataFrame:
    """``(*keys, true, mined, n, n_true, n_mined)``: lines that two groups share, and the lines of each."""
    counts = lines.groupBy(*keys, F.col(true).alias("true"), F.col(mined).alias("mined")).agg(F.count("*").alias("n"))
    of_true = counts.groupBy(*keys, "true").agg(F.sum("n").alias("n_true"))
    of_mined = counts.groupBy(*keys, "mined").agg(F.sum("n").alias("n_mined"))
    return counts.join(of_true, [*keys, "true"]).join(of_mined, [*keys, "mined"])


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def parsing_accuracy(lines: DataFrame, true: str, mined: str, keys: list[str]) -> DataFrame:
    """``(*keys, n_lines, precision, recall, f1, grouping_accuracy)`` per group of ``keys``.

    Precision and recall are about pairs of lines that are put together.  A line is grouped right if
    its mined group holds exactly the lines of its true one.  Without any pair a share is 1.
    """
    table = contingency(lines, true, mined, keys)
    both = F.sum(_pairs(F.col("n")))
    # A group is split over rows of the table; each row takes its part of the group's pairs.
    per_true = F.sum(_pairs(F.col("n_true")) * F.col("n") / F.col("n_true"))
    per_mined = F.sum(_pairs(F.col("n_mined")) * F.col("n") / F.col("n_mined"))
    exact = F.sum(F.when((F.col("n") == F.col("n_true")) & (F.col("n") == F.col("n_mined")), F.col("n")).otherwise(0))
    sums = table.groupBy(*keys).agg(
        F.sum("n").alias("n_lines"),
        both.alias("_both"),
        per_true.alias("_true"),
        per_mined.alias("_mined"),
        (exact / F.sum("n")).alias("grouping_accuracy"),
    )
    share = lambda whole: F.when(F.col(whole) > 0, F.col("_both") / F.col(whole)).otherwise(1.0)
    f1 = F.when(F.col("_true") + F.col("_mined") > 0, 2 * F.col("_both") / (F.col("_true") + F.col("_mined"))).otherwise(1.0)
    return sums.select(
        *keys, "n_lines", share("_mined").alias("precision"), share("_true").alias("recall"), f1.alias("f1"), "grouping_accuracy"
    )
