import random

from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators import templates


def test_parameters_by_hand(spark):
    cases = [
        ("a b c <*>", "a b c 1", ["1"]),
        ("a b c", "a b c", []),
        ("a <*>", "b 1", []),
        ("from <*> to <*>", "from x to y", ["x", "y"]),
        ("cost <num> (<*>)", "cost 5 (6.0)", ["5", "6.0"]),
        ("two words <*>", "two   words  z", ["z"]),
        ("", "", []),
    ]
    df = spark.createDataFrame(cases, "template string, content string, expected array<string>")
    found = df.select(
        "expected",
        T.parameters(F.col("content"), T.parameter_pattern(F.col("template")), T.wildcard_count(F.col("template"))).alias("p"),
    )
    for row in found.collect():
        assert row.p == row.expected


def test_masks_tokens_and_similarity(spark):
    df = spark.createDataFrame([(" a\t10.0.0.1:80  b1 ",), ("",), ("   ",)], "c string")
    rows = df.select(
        T.template_text(F.col("c"), [r"(\d+\.){3}\d+(:\d+)?"]).alias("t"),
        T.tokens(F.col("c")).alias("w"),
        T.token_count(T.template_text(F.col("c"), [])).alias("n"),
    ).collect()
    assert [r.t for r in rows] == ["a <*> b1", "", ""]
    assert rows[0].w == ["a", "10.0.0.1:80", "b1"] and rows[1].w == [] and [r.n for r in rows] == [3, 0, 0]
    pair = spark.sql("SELECT split('a <*> c d', ' ') t, split('a b c x', ' ') l")
    row = pair.select(T.similarity(F.col("t"), F.col("l")).alias("s"), T.merge_tokens(F.col("t"), F.col("l")).alias("m")).first()
    assert row.s == 0.5 and row.m == ["a", "<*>", "c", "<*>"]


def test_events_are_numbered_by_first_line(spark):
    rows = [("l", 5, "b"), ("l", 9, "a"), ("l", 7, "a"), ("l", 8, "b"), ("m", 1, "a")]
    templated = spark.createDataFrame(rows, "log_id string, line_no bigint, template string")
    found = {(r.log_id, r.EventTemplate): (r.EventId, r.Occurrences, r.first_line) for r in templates.catalogue(templated).collect()}
    assert found == {("l", "b"): ("Event1", 2, 5), ("l", "a"): ("Event2", 2, 7), ("m", "a"): ("Event1", 1, 1)}


def brute_match(text, events, st):
    words, best = text.split(" "), None
    for number, template in events:
        tokens = template.split(" ")
        if len(tokens) == len(words):
            hits = sum(a == b != "<*>" for a, b in zip(tokens, words))
            key = (hits, tokens.count("<*>"), -number)
            if hits / len(words) >= st and (best is None or key > best):
                best = key
    return None if best is None else f"Event{-best[2]}"


def test_match_catalogue_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(templates, "LIST_EVENTS", 3)
    draw = random.Random(3)
    make = lambda: " ".join(draw.choice(["a", "b", "c", "<*>"]) for _ in range(draw.randint(1, 4)))
    events = list(enumerate(dict.fromkeys(make() for _ in range(40)), 1))
    texts = [make() for _ in range(200)]
    catalogue = spark.createDataFrame(
        [("l", f"Event{n}", t) for n, t in events], "log_id string, EventId string, EventTemplate string"
    )
    lines = spark.createDataFrame(
        [("l", i, t, len(t.split(" "))) for i, t in enumerate(texts)],
        "log_id string, line_no bigint, template string, n_tokens int",
    )
    got = {r.line_no: r.EventId for r in templates.match_catalogue(lines, catalogue, 0.5).collect()}
    assert got == {i: brute_match(t, events, 0.5) for i, t in enumerate(texts)}
