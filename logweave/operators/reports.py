"""Report tables over metric values ``(sheet, category, model, metric, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.scoring import COSINE, ROUGE
from logweave.session import lookup_join, materialize

METRICS = (COSINE, ROUGE)

# Task categories in report order.
CATEGORIES = (
    "Summarization",
    "Pattern Extraction",
    "Anomaly Detection",
    "Root Cause Analysis",
    "Predictive Failure Analysis",
    "Log Understanding and Interpretation",
    "Log Filtering and Search",
)

# Value ranges of an exact quantile; each is sorted by its own task.
QUANTILE_RANGES = 64


def round2(value: Column) -> Column:
    """Two decimals, halves to even on the scaled value."""
    return F.rint(value * 100) / 100


def pivot_by_model(metrics: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row per sheet and model, one column ``<metric> (<category>)`` per pair."""
    names = [f"{metric} ({category})" for category in categories for metric in METRICS]
    key = F.concat("metric", F.lit(" ("), "category", F.lit(")"))
    return metrics.withColumn("_key", key).groupBy("sheet", "model").pivot("_key", names).agg(F.avg("value"))


def pivot_by_category(
    metrics: DataFrame, models: list[str], categories: tuple[str, ...] = CATEGORIES
) -> DataFrame:
    """One row per sheet and category, one column ``<model> <metric>`` per pair.

    Model and metric pairs without values give null columns.  Rows carry ``position``, the
    place of their category in report order.
    """
    names = [f"{model} {metric}" for model in models for metric in METRICS]
    position = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    return (
        metrics.filter(F.col("category").isin(*categories))
        .withColumn("_key", F.concat_ws(" ", "model", "metric"))
        .groupBy("sheet", "category")
        .pivot("_key", names)
        .agg(F.avg("value"))
        .withColumn("position", position.cast("bigint"))
    )


def wide_to_metrics(wide: DataFrame) -> DataFrame:
    """Back from ``<model> <metric>`` columns to one row per value."""
    ids = [c for c in ("sheet", "category", "position") if c in wide.columns]
    values = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, values, "_key", "value").filter(F.col("value").isNotNull())
    metric = F.when(F.endswith("_key", F.lit(COSINE)), F.lit(COSINE)).otherwise(F.lit(ROUGE))
    model = F.rtrim(F.replace(F.replace("_key", F.lit(COSINE), F.lit("")), F.lit(ROUGE), F.lit("")))
    return long.select("sheet", "category", model.alias("model"), metric.alias("metric"), "value")


def cell_means(metrics: DataFrame) -> DataFrame:
    """Means per (sheet, category, model, metric) and per (sheet, model, metric) from one scan.

    ``category`` is null in the coarser rows, which ``coarse`` marks.
    """
    fine = ["sheet", "category", "model", "metric"]
    sets = [[F.col(c) for c in fine], [F.col(c) for c in fine if c != "category"]]
    return metrics.groupingSets(sets, *fine).agg(
        F.avg("value").alias("value"), (F.grouping("category") == 1).alias("coarse")
    )


def mean_reports(metrics: DataFrame) -> DataFrame:
    """``(report, sheet, category, model, metric, value)``: the means of three reports from one scan of the metrics.

    Cells are means per sheet and category; categories and models are means of the sheets' means.
    """
    cells = materialize(cell_means(metrics), "cell_means")
    none = F.lit(None).cast("string")
    fine, coarse = cells.filter("not coarse"), cells.filter("coarse")
    over_sheets = lambda rows, *keys: rows.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))
    columns = ["sheet", "category", "model", "metric", "value"]
    parts = {
        "cell": fine,
        "category": over_sheets(fine, "category", "model").withColumn("sheet", none),
        "model": over_sheets(coarse, "model").withColumn("sheet", none).withColumn("category", none),
    }
    found = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("report"), *columns)
        found = rows if found is None else found.unionByName(rows)
    return found


def category_mean(metrics: DataFrame) -> DataFrame:
    """Mean over sheets per category, model and metric, to two decimals."""
    per_sheet = metrics.groupBy("sheet", "category", "model", "metric").agg(F.avg("value").alias("value"))
    return per_sheet.groupBy("category", "model", "metric").agg(round2(F.avg("value")).alias("value"))


def improvement(means: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Percent by which the baseline's value exceeds each other model's, per ``keys``."""
    base = means.filter(F.col("model") == baseline).select(*keys, F.col("value").alias("base"))
    return (
        means.filter(F.col("model") != baseline)
        .join(base, keys)
        .select(*keys, "model", ((F.col("base") - F.col("value")) / F.col("base") * 100).alias("improvement"))
    )


def category_improvement(means: DataFrame, baseline: str) -> DataFrame:
    """Mean improvement over the other models per category and metric, to two decimals."""
    return (
        improvement(means, baseline, ["category", "metric"])
        .groupBy("category", "metric")
        .agg(round2(F.avg("improvement")).alias("improvement"))
    )


def total_improvement(per_category: DataFrame) -> DataFrame:
    return per_category.groupBy("metric").agg(F.avg("improvement").alias("improvement"))


def category_ranking(per_category: DataFrame) -> DataFrame:
    """Categories by the mean improvement of all metrics, best first."""
    ranked = per_category.groupBy("category").agg(F.avg("improvement").alias("improvement"))
    order = W.orderBy(F.desc("improvement"), "category")  # one row per category
    return ranked.withColumn("place", F.row_number().over(order).cast("bigint"))


def model_means(metrics: DataFrame) -> DataFrame:
    """Mean per model and metric: over each sheet first, then over sheets; best first."""
    per_sheet = metrics.groupBy("sheet", "model", "metric").agg(F.avg("value").alias("value"))
    means = per_sheet.groupBy("model", "metric").agg(F.avg("value").alias("value"))
    order = W.partitionBy("metric").orderBy(F.desc("value"), "model")
    return means.withColumn("place", F.row_number().over(order).cast("bigint"))


def overall_improvement(metrics: DataFrame, baseline: str) -> DataFrame:
    """Improvement over each model, with the mean over all of them on every row."""
    each = improvement(model_means(metrics), baseline, ["metric"])
    return each.withColumn("mean_improvement", F.avg("improvement").over(W.partitionBy("metric")))


def task_ranking(metrics: DataFrame, model: str) -> DataFrame:
    """Categories of one model by mean value per metric, best first."""
    means = (
        metrics.filter(F.col("model") == model).groupBy("metric", "category").agg(F.avg("value").alias("value"))
    )
    order = W.partitionBy("metric").orderBy(F.desc("value"), "category")
    return means.withColumn("place", F.row_number().over(order).cast("bigint"))


def _group_key(keys: list[str]) -> Column:
    return F.struct(*keys).alias("_key")


def quantiles(df: DataFrame, keys: list[str], probabilities: dict[str, float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name.

    Equal values are counted first, so a value that fills a group is one row.  The distinct
    values of a group are cut into ranges at approximate quantiles, each range is sorted by
    its own task, and range totals place it in the group: no task sees a whole group.
    """
    # One struct for the keys: groups whose key holds a null meet in joins like any other.
    rows = df.filter(F.col(value).isNotNull()).select(_group_key(keys), value)
    counted = materialize(rows.groupBy("_key", value).agg(F.count("*").alias("_n")), "values")
    cuts = [i / QUANTILE_RANGES for i in range(1, QUANTILE_RANGES)]
    groups = counted.groupBy("_key").agg(
        F.sum("_n").alias("_total"), F.percentile_approx(value, cuts, 1000).alias("_cuts")
    )
    ranged = lookup_join(counted, groups, ["_key"], "inner").withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    )
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_key", "_range").agg(F.sum("_n").alias("_size")).select(
        "_key", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy("_key", "_range").orderBy(value)
    reached = (
        ranged.withColumn("_reached", F.sum("_n").over(inside))
        .join(offsets, ["_key", "_range"])
        .withColumn("_reached", F.col("_reached") + F.col("_offset"))
    )

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_reached") > rank, F.col(value)))

    def quantile(p: float) -> Column:
        low = F.floor((F.col("_total") - 1) * p)
        high = F.ceil((F.col("_total") - 1) * p)
        share = F.max((F.col("_total") - 1) * p - low)
        return at_rank(low) + (at_rank(high) - at_rank(low)) * share

    found = reached.groupBy("_key").agg(
        F.max("_total").alias("n_values"), *[quantile(p).alias(name) for name, p in probabilities.items()]
    )
    return found.select("_key.*", "n_values", *probabilities)


def iqr(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and their distance per group."""
    found = quantiles(metrics, keys, {"q1": 0.25, "q3": 0.75})
    return found.withColumn("iqr", F.col("q3") - F.col("q1"))


def medians(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return quantiles(metrics, keys, {"median": 0.5})


def with_fences(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the 1.5·IQR fences of their group and an ``outlier`` flag."""
    spread = iqr(metrics, keys).select(
        _group_key(keys),
        (F.col("q1") - 1.5 * F.col("iqr")).alias("low"),
        (F.col("q3") + 1.5 * F.col("iqr")).alias("high"),
    )
    joined = lookup_join(metrics.withColumn("_key", _group_key(keys)), spread, ["_key"], "inner")
    return joined.drop("_key").withColumn("outlier", (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def outliers(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Values outside the fences of their group."""
    return with_fences(metrics, keys).filter("outlier").drop("outlier")


def outlier_share(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Number and percentage of outliers per group."""
    counts = with_fences(metrics, keys).groupBy(*keys).agg(
        F.count("*").alias("n_values"), F.count_if("outlier").alias("n_outliers")
    )
    return counts.withColumn("percent", F.col("n_outliers") / F.col("n_values") * 100)


def iqr_narrowing(metrics: DataFrame, baseline: str) -> DataFrame:
    """Mean percent by which the other models' IQR exceeds the baseline's, per metric."""
    spread = iqr(metrics, ["model", "metric"])
    base = spread.filter(F.col("model") == baseline).select("metric", F.col("iqr").alias("base"))
    return (
        spread.filter(F.col("model") != baseline)
        .join(base, "metric")
        .groupBy("metric")
        .agg((F.avg(F.col("iqr") / F.col("base") - 1) * 100).alias("narrowing"))
    )


def _with_baseline(spread: DataFrame, baseline: str) -> DataFrame:
    base = spread.filter(F.col("model") == baseline).select("category", "metric", F.col("iqr").alias("base"))
    difference = F.when(F.col("model") != baseline, F.col("base") - F.col("iqr"))
    return spread.join(base, ["category", "metric"]).withColumn("difference", difference)


def _labelled(ratio: DataFrame) -> DataFrame:
    label = F.when(F.col("percent") > 0, F.lit("wider")).otherwise(F.lit("narrower"))
    return ratio.withColumn("label", label)


def category_robustness(metrics: DataFrame, baseline: str) -> DataFrame:
    """Mean IQR difference to the baseline relative to the mean IQR, per category and metric."""
    spread = _with_baseline(iqr(metrics, ["category", "model", "metric"]), baseline)
    return _labelled(
        spread.groupBy("category", "metric").agg(
            (F.avg("difference") / F.avg("iqr") * 100).alias("percent")
        )
    )


def final_robustness(metrics: DataFrame, baseline: str) -> DataFrame:
    """Mean IQR difference over all categories relative to the baseline's mean IQR."""
    spread = _with_baseline(iqr(metrics, ["category", "model", "metric"]), baseline)
    own = F.avg(F.when(F.col("model") == baseline, F.col("iqr")))
    return _labelled(
        spread.groupBy("metric").agg((F.avg("difference") / own * 100).alias("percent"))
    )


def box_stats(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """What a box plot draws: quartiles, median, whisker ends and number of outliers."""
    boxes = quantiles(metrics, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    marked = with_fences(metrics, keys)
    inside = F.when(~F.col("outlier"), F.col("value"))
    whiskers = marked.groupBy(*keys).agg(
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if("outlier").alias("n_outliers"),
    )
    boxes = boxes.withColumn("_key", _group_key(keys))
    return boxes.join(whiskers.withColumn("_key", _group_key(keys)).drop(*keys), "_key").drop("_key")
