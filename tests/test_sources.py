import glob
import os

import pytest
from pyspark.sql import functions as F

from logweave.plans.log_analysis import analyse
from logweave.sources import tables
from logweave.sources.lines import contiguous_ids, read_log_lines


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i} {'x' * (i % 40)}\n" for i in range(1, 3001)))
    (tmp_path / "small.log").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = read_log_lines(spark, str(tmp_path / "*.log"))
        assert lines.rdd.getNumPartitions() > 3
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    big = {r.line_no: r.line for r in rows if r.log_id == "big.log"}
    assert sorted(big) == list(range(1, 3001))
    assert all(text.startswith(f"line {number} ") for number, text in big.items())
    assert [(r.line_no, r.line) for r in rows if r.log_id == "small.log"] == [(1, "only")]


def test_a_changed_split_plan_loses_no_line(spark, tmp_path):
    count = 600_000
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, count + 1)))
    setting = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(setting)
    lines = read_log_lines(spark, str(tmp_path))
    spark.conf.set(setting, "1m")
    try:
        right = F.col("line") == F.concat(F.lit("line "), F.col("line_no"))
        row = lines.agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_distinct("line_no").alias("d")).first()
    finally:
        spark.conf.set(setting, old)
    assert tuple(row) == (count, count, count)


def test_logs_of_equal_names_stay_apart(spark, tmp_path):
    for folder, text in (("a", "x\ny\n"), ("b", "z\n"), ("c d+e%", "w\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "app.log").write_text(text)
    rows = read_log_lines(spark, str(tmp_path / "*" / "app.log")).collect()
    assert sorted((r.log_id, r.line_no, r.line) for r in rows) == [
        ("a/app.log", 1, "x"), ("a/app.log", 2, "y"), ("b/app.log", 1, "z"), ("c d+e%/app.log", 1, "w"),
    ]
    single = read_log_lines(spark, [f"file://{tmp_path}/b/app.log"]).collect()
    assert [(r.log_id, r.line_no) for r in single] == [("app.log", 1)]


def test_contiguous_ids_with_small_buckets(spark):
    df = spark.range(0, 500, 7).select((F.col("id") % 3).alias("k"), "id")
    rows = contiguous_ids(df, "k", "id", "n", bucket_rows=20).collect()
    for key in range(3):
        ordered = sorted((r.id, r.n) for r in rows if r.k == key)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))


def test_writing_one_log_leaves_the_others(spark, tmp_path):
    root = str(tmp_path)
    make = lambda rows: spark.createDataFrame(rows, "log_id string, n bigint")
    tables.write_by_log(make([("a", 1), ("b", 2)]), root, "t")
    tables.write_by_log(make([("a", 9)]), root, "t")
    rows = tables.read_by_log(spark, root, "t", "n bigint, log_id string").collect()
    assert sorted((r.log_id, r.n) for r in rows) == [("a", 9), ("b", 2)]


def test_exchanges_survive_a_broken_record(spark, tmp_path):
    path = str(tmp_path / "x")
    row = spark.createDataFrame(
        [("q", "a", "", "2024-01-01 00:00:00", "1.00 seconds")],
        "user_input string, response string, extra_info string, timestamp string, response_time string",
    )
    tables.append_exchanges(row, path)
    tables.append_exchanges(row, path)
    with open(os.path.join(path, "part-broken.json"), "w") as out:
        out.write('{"user_input": "cut\n')
    rows = tables.read_exchanges(spark, path).collect()
    assert sum(r.user_input == "q" for r in rows) == 2
    assert sum(r._corrupt_record is not None for r in rows) == 1


def test_csv_keeps_quotes_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", x', ["a", "b"])], "t string, l array<string>")
    tables.write_csv(df, str(tmp_path / "c"))
    row = tables.read_csv(spark, str(tmp_path / "c"), "t string, l string").first()
    assert row.t == 'say "hi", x' and row.l == '["a","b"]'


def test_metric_files_have_two_decimals(spark, tmp_path):
    wide = spark.createDataFrame([("S", "C", 0.126, 0.5)], "sheet string, category string, `m A` double, `m B` double")
    tables.write_metrics(wide, str(tmp_path / "m"))
    (part,) = glob.glob(str(tmp_path / "m" / "sheet=S" / "*.csv"))
    assert open(part).read().splitlines() == ["category,m A,m B", "C,0.13,0.50"]
    row = tables.read_metrics(spark, str(tmp_path / "m"), ["m A", "m B"]).first()
    assert (row.sheet, row["m A"], row["m B"]) == ("S", 0.13, 0.5)


def test_analyse_a_small_log(spark):
    texts = ["[t] [notice] child 1 started", "[t] [notice] child 2 started", "junk", "[t] [error] no file from 1.2.3.4"]
    lines = spark.createDataFrame(
        [("a.log", i + 1, t) for i, t in enumerate(texts)], "log_id string, line_no bigint, line string"
    )
    found = analyse(lines, "Apache")
    rows = found.structured.orderBy("line_no").collect()
    assert [(r.line_no, r.LineId, r.EventId, r.ParameterList) for r in rows] == [
        (1, 1, "Event1", ["1"]), (2, 2, "Event1", ["2"]), (4, 3, "Event2", ["1.2.3.4"]),
    ]
    assert rows[0].EventTemplate == "child <*> started" and rows[2].line == texts[3]
    counts = {r.EventId: r.Occurrences for r in found.catalogue.collect()}
    assert counts == {"Event1": 2, "Event2": 1}
    plain = analyse(lines, "Apache", mined=False)
    assert plain.catalogue.count() == 3
