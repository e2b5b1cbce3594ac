import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import search
from logweave.operators.mining import mine_assignments  # noqa: F401
from logweave.session import lookup_join

SCHEMA = "log_id string, line_no bigint, line string"


def lines_df(spark, texts):
    return spark.createDataFrame([("l", i + 1, t) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(
    ("keywords", "expected"),
    [(["ALERT"], [1, 2]), (["alert", "Alert"], [1, 2]), ([""], [1, 2, 3, 4]), (["[x]", "a.b"], [3]), (["nope"], []), ([], [])],
)
def test_keyword_search(spark, keywords, expected):
    lines = lines_df(spark, ["an alert ", "ALERT!", "see [X] now", "aXb"])
    assert sorted(r.line_no for r in search.keyword_search(lines, keywords).collect()) == expected


@pytest.mark.parametrize("n", [199, 200, 201])
def test_cap_and_true_total(spark, n):
    lines = lines_df(spark, ["hit"] * n + ["miss"])
    rows = search.cap_matches(search.keyword_search(lines, ["hit"]), ["log_id"], 200).collect()
    assert len(rows) == min(n, 200) and {r.n_matched for r in rows} == {n}
    assert {r.trimmed for r in rows} == {n >= 200} and {r.place for r in rows} == set(range(1, min(n, 200) + 1))


@pytest.mark.parametrize("inline_words", [0, 64])
def test_keyword_sets_against_brute_force(spark, inline_words):
    draw = random.Random(11)
    texts = ["".join(draw.choices("abAB é.", k=draw.randint(0, 9))) for _ in range(120)]
    questions = [
        (i, ["".join(draw.choices("abé.", k=draw.randint(0, 4))) for _ in range(draw.randint(0, 3))]) for i in range(40)
    ]
    asked = search.with_set_key(spark.createDataFrame(questions, "question_id int, keywords array<string>"))
    sets = search.KeywordSets(lines_df(spark, texts), asked, inline_words)
    keys = {r.question_id: r.set_key for r in asked.collect()}
    full, capped = {}, {}
    for r in sets.matches().collect():
        full.setdefault(r.set_key, []).append((r.line_no, r.line))
    for r in sets.capped(7).collect():
        capped.setdefault(r.set_key, []).append((r.place, r.line_no, r.n_matched, r.trimmed))
    for number, keywords in questions:
        expected = [
            (i + 1, t.strip()) for i, t in enumerate(texts) if any(k.lower() in t.lower() for k in keywords)
        ]
        if not keywords:
            continue
        assert sorted(full.get(keys[number], [])) == expected
        shown = [(p + 1, e[0], len(expected), len(expected) >= 7) for p, e in enumerate(expected[:7])]
        assert sorted(capped.get(keys[number], [])) == shown


def test_capped_keeps_logs_apart(spark):
    rows = [("a", 1, "error a1"), ("a", 2, "nothing a2"), ("b", 1, "nothing b1"), ("b", 2, "ERROR b2"), ("b", 3, "error warn b3")]
    lines = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(1, ["error"]), (2, ["warn", "Error"])], "question_id bigint, keywords array<string>")
    found = search.KeywordSets(lines, asked).capped(5).collect()
    got = {}
    for r in found:
        got.setdefault((r.set_key, r.log_id), []).append((r.place, r.line, r.n_matched))
    both = {"a": [(1, "error a1", 1)], "b": [(1, "ERROR b2", 2), (2, "error warn b3", 2)]}
    assert len(got) == 4
    for (_, log), hits in got.items():
        assert sorted(hits) == both[log]


def test_mentions_in_first_seen_order(spark):
    df = spark.createDataFrame([(1, "Event2 and Event1, Event2, myEvent3"), (2, "none")], "id int, text string")
    assert [(r.id, r.place, r.EventId) for r in search.mentions(df).collect()] == [(1, 0, "Event2"), (1, 1, "Event1")]


def test_event_lines_and_pages(spark):
    rows = [("l", i, f"line {i}", "Event1" if i % 3 else "Event2") for i in range(1, 31)]
    structured = spark.createDataFrame(rows, SCHEMA + ", EventId string")
    found = search.event_lines(structured).filter("EventId = 'Event2'").orderBy("place").collect()
    assert [(r.place, r.line_no) for r in found] == [(i + 1, 3 * (i + 1)) for i in range(10)]
    pages = search.event_pages(structured, 4).filter("EventId = 'Event2'").orderBy("page").collect()
    assert [len(r.lines) for r in pages] == [4, 4, 2] and pages[0].lines[0] == "line 3"
    wanted = spark.createDataFrame([("Event2",), ("Event2",), ("Event9",)], "EventId string")
    assert search.event_hits(structured, wanted).count() == 10
    named = spark.createDataFrame([("Event2 Event9",), ("Event2",)], "text string")
    assert {(r.EventId, r.n_mentions) for r in search.mention_lines(named, structured).collect()} == {("Event2", 2)}


def test_lookup_join_beyond_the_broadcast_bound(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7))
    lookup = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k bigint, v string")
    small = lookup_join(rows, lookup, ["k"])
    large = lookup_join(rows, lookup, ["k"], broadcast_bytes=0)
    order = lambda df: sorted((r.id, r.k, r.v) for r in df.select("id", "k", "v").collect())
    assert order(small) == order(large) and large.count() == 1000
