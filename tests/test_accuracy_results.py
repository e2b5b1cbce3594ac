"""Agreement of groupings against all pairs, and results of a log that are replaced."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from logweave.operators.accuracy import parsing_accuracy
from logweave.operators.reports import cell_means
from logweave.sources import tables


def plain(rows):
    true, mined, both = 0, 0, 0
    for (a, b), (c, d) in combinations(rows, 2):
        true, mined, both = true + (a == c), mined + (b == d), both + (a == c and b == d)
    group = lambda place: {k: {n for n, r in enumerate(rows) if r[place] == k} for k in {r[place] for r in rows}}
    of_true, of_mined = group(0), group(1)
    exact = sum(of_true[a] == of_mined[b] for a, b in rows)
    share = lambda whole: both / whole if whole else 1.0
    return share(mined), share(true), 2 * both / (true + mined) if true + mined else 1.0, exact / len(rows)


def test_accuracy_against_all_pairs(spark):
    random.seed(9)
    logs = {
        "mixed": [(random.choice("abc"), random.choice("xyz")) for _ in range(60)],
        "same": [("a", "x")] * 20 + [("b", "y")] * 10,
        "split": [("a", str(n)) for n in range(10)],
        "one": [("a", "x")],
    }
    rows = [(name, t, m) for name, pairs in logs.items() for t, m in pairs]
    frame = spark.createDataFrame(rows, "log_id string, t string, m string")
    found = {r.log_id: r for r in parsing_accuracy(frame, "t", "m", ["log_id"]).collect()}
    for name, pairs in logs.items():
        r = found[name]
        assert (r.precision, r.recall, r.f1, r.grouping_accuracy) == pytest.approx(plain(pairs)) and r.n_lines == len(pairs)


def test_replacing_a_log_keeps_the_others_and_survives_a_failed_write(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "log_id string, line_no bigint")
    tables.write_by_log(rows, root, "structured")
    tables.write_by_log(spark.createDataFrame([("a", 9)], "log_id string, line_no bigint"), root, "structured")
    read = lambda: sorted((r.log_id, r.line_no) for r in tables.read_by_log(spark, root, "structured").collect())
    assert read() == [("a", 9), ("b", 3)]
    broken = spark.range(100, numPartitions=4).select(
        F.lit("b").alias("log_id"), F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("bigint").alias("line_no")
    )
    with pytest.raises(Exception, match="lost"):
        tables.write_by_log(broken, root, "structured")
    assert read() == [("a", 9), ("b", 3)]


def test_two_grains_from_one_scan(spark):
    rows = [("s", "c", "m", "x", 1.0), ("s", "c", "m", "x", 2.0), ("s", "d", "m", "x", 9.0), ("s", None, "m", "x", 4.0)]
    metrics = spark.createDataFrame(rows, "sheet string, category string, model string, metric string, value double")
    means = cell_means(metrics)
    assert {(r.category, r.coarse): r.value for r in means.collect()} == {
        ("c", False): 1.5, ("d", False): 9.0, (None, False): 4.0, (None, True): 4.0,
    }
    assert means._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
