import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.text import token_count
from logweave.operators import mining
from logweave.operators.templates import masked_lines

from sequential_model import mine

SCHEMA = "log_id string, line_no bigint, template string"


def mine_with_spark(spark, logs, st, depth, block_lines):
    rows = [(name, i + 1, " ".join(t.split())) for name, texts in logs.items() for i, t in enumerate(texts)]
    masked = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", token_count(F.col("template")))
    found = mining.mine_assignments(masked, st, depth, block_lines)
    lines = mining.attach_mined(masked, found, block_lines).collect()
    assert len(lines) == len(rows)
    result = {name: [None] * len(texts) for name, texts in logs.items()}
    for row in lines:
        result[row.log_id][row.line_no - 1] = row.template
    events = {}
    for row in mining.mined_catalogue(found).collect():
        events.setdefault(row.log_id, {})[row.EventTemplate] = (row.EventId, row.Occurrences)
    return result, events


def expected_events(templates):
    order = list(dict.fromkeys(templates))
    return {t: (f"Event{i + 1}", templates.count(t)) for i, t in enumerate(order)}


HAND_CASES = {
    "merge": (["a b c 1", "a b c 2"], 0.5, 4, ["a b c <*>"] * 2),
    "below threshold": (["a b c d", "a x y z"], 0.5, 4, ["a b c d", "a x y z"]),
    "length split": (["a b c", "a b c d"], 0.5, 4, ["a b c", "a b c d"]),
    "first key differs": (["a b c", "z b c"], 0.5, 4, ["a b c", "z b c"]),
    "digit key": (["1 b c", "2 b c"], 0.5, 4, ["<*> b c"] * 2),
    "short line": (["x", "x", "y"], 0.5, 5, ["x", "x", "y"]),
    "empty content": (["", ""], 0.5, 4, ["", ""]),
    "never matching": (["a <*> <*>", "a <*> <*>", "a b c"], 0.5, 4, ["a <*> <*>", "a <*> <*>", "a b c"]),
}


@pytest.mark.parametrize("name", HAND_CASES)
def test_sequential_model_on_hand_cases(name):
    texts, st, depth, expected = HAND_CASES[name]
    got = mine(texts, st, depth)
    assert got == expected


def test_hand_cases_in_one_job(spark):
    for depth in (4, 5):
        cases = {n: c for n, c in HAND_CASES.items() if c[2] == depth}
        got, events = mine_with_spark(spark, {n: c[0] for n, c in cases.items()}, 0.5, depth, 1 << 18)
        for name, (_, _, _, expected) in cases.items():
            assert got[name] == expected, name
            assert events[name] == expected_events(expected), name


def random_log(seed, n, vocabulary, max_words):
    draw = random.Random(seed)
    words = [f"w{c}" if draw.random() < 0.3 else "".join(draw.choices("abcdefg", k=2)) for c in range(vocabulary)]
    shapes = [draw.choices(words, k=draw.randint(1, max_words)) for _ in range(12)]
    texts = []
    for _ in range(n):
        shape = list(draw.choice(shapes))
        for _ in range(draw.randint(0, 2)):
            place = draw.randrange(len(shape))
            shape[place] = draw.choice(["<*>", "7", draw.choice(words), "x" + str(draw.randint(0, 5))])
        texts.append(" ".join(shape))
    return texts


@pytest.mark.parametrize(
    ("st", "depth", "block_lines"), [(0.5, 4, 40), (0.39, 6, 60), (0.6, 3, 1000), (0.2, 6, 25), (0.7, 5, 100)]
)
def test_blocks_give_the_sequential_result(spark, st, depth, block_lines):
    logs = {"one": random_log(1, 150, 12, 6), "two": random_log(2, 150, 40, 7)}
    got, events = mine_with_spark(spark, logs, st, depth, block_lines)
    for name, texts in logs.items():
        expected = mine(texts, st, depth)
        assert got[name] == expected
        assert events[name] == expected_events(expected)


def test_branch_limit(spark):
    words = [f"{a}{b}" for a in "abcdefghijk" for b in "abcdefghijk"]
    texts = [f"{w} said {v}" for w in words for v in ("yes", "no")] + ["zz said yes", "aa said 5"]
    got, _ = mine_with_spark(spark, {"log": texts}, 0.6, 4, 1 << 18)
    assert got["log"] == mine(texts, 0.6, 4)


def test_masked_lines_feed_the_miner(spark):
    rows = [("l", 1, "took  5 ms at 10.0.0.1"), ("l", 2, "took 7 ms at\t10.0.0.2")]
    parsed = spark.createDataFrame(rows, "log_id string, line_no bigint, Content string")
    out = masked_lines(parsed, [r"(\d+\.){3}\d+"]).orderBy("line_no").collect()
    assert [(r.template, r.n_tokens) for r in out] == [("took 5 ms at <*>", 5), ("took 7 ms at <*>", 5)]


def test_rendered_log_gives_the_sequential_result(spark):
    from logweave.operators.parsing import parse_lines
    from logweave.sources.rendered import event_log_lines

    parsed = parse_lines(event_log_lines(spark, "/root/testdata/sf0.001"), "Spark")
    masked = masked_lines(parsed, [r"(\d+\.){3}\d+"]).select("log_id", "line_no", "template", "n_tokens")
    ordered = [r.template for r in masked.orderBy("line_no").collect()]
    expected = mine(ordered, 0.5, 4)
    found = mining.mine_assignments(masked, 0.5, 4, block_lines=150)
    got = mining.attach_mined(masked, found, 150).orderBy("line_no").collect()
    assert [r.template for r in got] == expected
    events = {r.EventTemplate: (r.EventId, r.Occurrences) for r in mining.mined_catalogue(found).collect()}
    assert events == expected_events(expected)


def test_control_characters_in_key_tokens(spark):
    texts = ["a\u0001b c d 1", "x y z", "a\u0001b c d 2", "a\u0001b c d 3", "a b\u0001c d 1", "a b\u0001c d 2"]
    expected = mine(texts, 0.5, 5)
    for block_lines in (1, 2, 1 << 18):
        got, _ = mine_with_spark(spark, {"l": texts}, 0.5, 5, block_lines)
        assert got["l"] == expected, block_lines


def test_branch_limit_across_blocks(spark):
    """The number of branches is part of the state where the limit acts, at both key tokens."""
    words = [f"{a}{b}" for a in "abcdefghijk" for b in "abcdefghijk"]
    texts = [f"{w} said x y {v}" for w in words for v in ("yes", "no")] + ["zz said x y yes", "aa said x y 5", "ab lost x y z"]
    texts += [f"aa {w} x y z" for w in words] + ["aa zz x y z", "kk said x y yes"]
    got, _ = mine_with_spark(spark, {"log": texts}, 0.6, 5, 130)
    assert got["log"] == mine(texts, 0.6, 5)


def test_state_rows_follow_changed_leaves(spark, monkeypatch):
    """State goes to the units whose lines can meet it, and again only where a leaf changed."""
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [f"{name} came from {n} hosts" for name in names for n in "xy"]
    for block in range(1, 11):
        own = names[block]
        texts += [f"{own} came from z hosts" if n % 2 else "one two three" for n in range(128)]
        if block == 5:
            # A template loses one more token: only later units with that first word see it.
            texts[-1] = f"{names[8]} came by x hosts"
    counts = {}
    keep = mining.materialize

    def counted(df, label):
        made = keep(df, label)
        counts.setdefault(label, []).append(made.count())
        return made

    monkeypatch.setattr(mining, "materialize", counted)
    got, _ = mine_with_spark(spark, {"log": texts}, 0.5, 4, 128)
    monkeypatch.undo()
    assert got["log"] == mine(texts, 0.5, 4)
    blocks, templates = len(texts) // 128, len(names)
    # A cluster and its node per unit and asked path, not every template for every later block.
    assert counts["start"][0] < 6 * blocks < templates * blocks / 8
    # The one change reaches a single later unit.
    assert counts["again"] and sum(counts["todo"][1:]) <= 3
