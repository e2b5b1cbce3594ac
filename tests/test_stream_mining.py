"""Mining over micro-batches, stopped and started again, against one pass in order."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.functions.text import token_count
from logweave.streaming import mining as online

from sequential_model import mine
from test_mining import expected_events, random_log

SCHEMA = "log_id string, line_no bigint, template string, n_tokens int"


@pytest.fixture(scope="module")
def session(spark):
    own = spark.newSession()
    own.conf.set(online.STATE_STORE, online.ROCKS_DB)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    return own


def arrive(session, folder, logs, number, begin, end):
    rows = [(n, i + 1, " ".join(t.split())) for n, texts in logs.items() for i, t in enumerate(texts) if begin <= i < end]
    lines = session.createDataFrame(rows, "log_id string, line_no bigint, template string")
    lines.withColumn("n_tokens", token_count(F.col("template"))).coalesce(1).write.parquet(f"{folder}/in/part={number}")
    time.sleep(0.05)


def run(session, folder, st, depth):
    stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    started = online.write_mined(online.mine_stream(stream, st, depth), f"{folder}/out", f"{folder}/check", availableNow=True)
    started.awaitTermination()


@pytest.mark.parametrize(("st", "depth"), [(0.5, 4), (0.39, 6)])
def test_micro_batches_and_a_restart_give_the_sequential_result(session, tmp_path, st, depth):
    folder = str(tmp_path)
    logs = {"one": random_log(1, 150, 12, 6) + ["", "", "x"], "two": random_log(2, 150, 40, 7)}
    arrive(session, folder, logs, 0, 0, 40)
    arrive(session, folder, logs, 1, 40, 90)
    run(session, folder, st, depth)
    # The query has ended; a new one goes on from its checkpoint.
    arrive(session, folder, logs, 2, 90, 100)
    arrive(session, folder, logs, 3, 100, 1000)
    run(session, folder, st, depth)
    lines = online.mined_lines(session, f"{folder}/out")
    for name, texts in logs.items():
        expected = mine(texts, st, depth)
        found = {r.line_no: r.template for r in lines.filter(F.col("log_id") == name).collect()}
        assert [found[n + 1] for n in range(len(texts))] == expected and len(found) == len(texts)
        events = online.mined_events(lines.filter(F.col("log_id") == name)).collect()
        assert {r.EventTemplate: (r.EventId, r.Occurrences) for r in events} == expected_events(expected)


def test_branch_limit_over_micro_batches(session, tmp_path):
    folder = str(tmp_path)
    words = [f"{a}{b}" for a in "abcdefghijk" for b in "abcdefghijk"]
    logs = {"log": [f"{w} said {v}" for w in words for v in ("yes", "no")] + ["zz said yes", "aa said 5"]}
    for number in range(3):
        arrive(session, folder, logs, number, 90 * number, 90 * number + 90)
    run(session, folder, 0.6, 4)
    found = {r.line_no: r.template for r in online.mined_lines(session, f"{folder}/out").collect()}
    assert [found[n] for n in sorted(found)] == mine(logs["log"], 0.6, 4)


def test_needs_the_state_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'l' AS log_id", "value AS line_no", "'a b' AS template", "2 AS n_tokens")
    with pytest.raises(ValueError, match="RocksDB"):
        online.mine_stream(stream, 0.5, 4)


def test_slices_of_a_micro_batch_give_the_sequential_result(session, tmp_path, monkeypatch):
    """A micro-batch is mined slice by slice, whatever order its rows come in."""
    folder = str(tmp_path)
    logs = {"one": random_log(3, 200, 12, 6) + ["", "x"], "two": random_log(4, 200, 30, 7)}
    taken = []
    monkeypatch.setattr(online, "SLICE_LINES", 16)
    processor = online.Miner(0.5, 4)
    monkeypatch.setattr(processor, "_mine", lambda lines, *rest, own=processor._mine: (taken.append(len(lines)), own(lines, *rest))[1])

    class State(dict):
        containsKey, updateValue, getValue = dict.__contains__, dict.__setitem__, dict.__getitem__

    for texts in logs.values():
        processor.nodes = None
        states = {}
        rows = [(n + 1, " ".join(t.split())) for n, t in enumerate(texts)]
        by_width = {}
        for line, text in rows:
            by_width.setdefault(len(text.split(" ")) if text else 0, []).append((line, text))
        lines, latest = {}, {}
        for width, own in by_width.items():
            processor.nodes = states.setdefault(width, State())
            parts = [pd.DataFrame(own[at::3], columns=["line_no", "template"]) for at in range(min(3, len(own)))]
            for frame in processor.handleInputRows(("log", width), iter(parts), None):
                for kind, line, cluster, template in frame[["kind", "line_no", "cluster", "template"]].itertuples(index=False):
                    if kind == "line":
                        lines[line] = template if pd.isna(cluster) else (width, cluster)
                    else:
                        assert (width, cluster) not in latest
                        latest[width, cluster] = template
        found = [latest.get(lines[n], lines[n]) for n, _ in rows]
        assert found == mine(texts, 0.5, 4)
    assert max(taken) == 16
