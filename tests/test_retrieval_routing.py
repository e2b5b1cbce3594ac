import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import conversations, retrieval, routing
from logweave.plans.answers import answer_questions

SCHEMA = "log_id string, line_no bigint, line string"


def greedy(sizes, budget):
    chunks, used, number = [], 0, -1
    for size in sizes:
        if number < 0 or used + size > budget:
            number, used = number + 1, 0
        used += size
        chunks.append(number)
    return chunks


def test_chunks_are_greedy(spark):
    draw = random.Random(1)
    sizes = [draw.choice([0, 1, 3, 5, 12]) for _ in range(200)]
    lines = spark.createDataFrame([("l", i + 1, "w " * n) for i, n in enumerate(sizes)], SCHEMA)
    numbers = greedy(sizes, 10)
    expected = [numbers.index(n) + 1 for n in numbers]
    for block_lines in (1, 2, 7, 64, 1 << 20):
        ids = retrieval.chunk_ids(lines, budget=10, block_lines=block_lines)
        assert [r.line_from for r in ids.orderBy("line_no").collect()] == expected, block_lines
    spans = retrieval.chunk_spans(lines, budget=10, block_lines=64).collect()
    assert sum(r.n_lines for r in spans) == 200 and all(r.n_tokens <= 12 for r in spans)
    texts = retrieval.chunk_texts(lines, retrieval.chunk_ids(lines, budget=10)).collect()
    assert sum(t.text.count("w") for t in texts) == sum(sizes)


QUESTIONS = {
    "Who are you?": "Generation",
    "How are you doing today?": "Generation",
    "What is a Brute Force Attack?": "Generation",
    "What kind of log file is this?": "Partial > Retrieve",
    "Summarize the log.": "All",
    "What does each column in this log mean?": "Partial > Retrieve",
    "Are there any abnormal activities?": "All",
    "Show the abnormal activities.": "All",
    "Identify the main anomaly activities.": "All",
    "What happened at 03:28:22?": "Partial > Search",
    "What happened at '03:28:22'?": "Partial > Search",
    "What is 'combo' in this log?": "Partial > Search",
    "How many times does 'ALERT' occur in the log file?": "Partial > Search",
    "How many times did the user login?": "Partial > Retrieve",
    "Which users have tried to log on to the FTP server?": "Partial > Retrieve",
    "What is the event Event5?": "Partial > Event",
    "Which users are trying to log on in the event of an Event7?": "Partial > Event",
    "What is the event5?": "Partial > Event",
}


def test_routes_of_sample_questions(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    rows = {r.question: r for r in routing.route_questions(df).collect()}
    assert {q: r.route for q, r in rows.items()} == QUESTIONS
    assert rows["What happened at '03:28:22'?"].keywords == ["03:28:22"]
    assert rows["What is 'combo' in this log?"].keywords == ["combo"]
    assert rows["What is the event5?"].events == ["Event5"]
    assert rows["What is the event Event5?"].events == ["Event5"]


def test_router_json(spark):
    texts = ['{"choice": "search", "keywords": ["a"]}', '{"choice": "event", "events": ["Event1"]}', "no json", "{}", None, '{"choice": "banana"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json string")
    rows = routing.parse_route_json(df).orderBy("id").collect()
    assert [r.choice for r in rows] == ["search", "event", None, None, None, "banana"]
    assert [r.usable for r in rows] == [True, True, False, False, False, False]
    assert rows[0].keywords == ["a"] and rows[1].events == ["Event1"]


def test_quotes_and_routes(spark):
    cases = {
        "What's in the log and who's logged on?": ("Partial > Retrieve", []),
        "How many times does 'error report' occur in the log?": ("Partial > Search", ["error report"]),
        "What is 'summary.txt' in this log?": ("Partial > Search", ["summary.txt"]),
        'Where is "ALERT" and \'a\',\'b\'?': ("Partial > Search", ["a", "b", "ALERT"]),
        "Give a summary of 'x'": ("All", []),
        "It's the dogs' owners' report": ("All", []),
    }
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    found = {r.question: (r.route, r.keywords) for r in routing.route_questions(df).collect()}
    assert found == cases


@pytest.mark.parametrize("question", ["What is the event Event1?", "Where is 'Boom' in the log?", "Summarize the log.", "Who are you?", "Which log line is it?"])
def test_batches_with_one_route(spark, question):
    structured = spark.createDataFrame([("l", 1, "Boom here", "Event1")], SCHEMA + ", EventId string")
    catalogue = spark.createDataFrame(
        [("l", "Event1", "Boom here", 1)], "log_id string, EventId string, EventTemplate string, Occurrences bigint"
    )
    asked = spark.createDataFrame([(1, question)], "question_id bigint, question string")
    rows = answer_questions(asked, structured.select("log_id", "line_no", "line"), structured, catalogue).collect()
    assert len(rows) == 1
    none = asked.limit(0)
    assert answer_questions(none, structured.select("log_id", "line_no", "line"), structured, catalogue).count() == 0


def test_answers(spark):
    texts = [f"ok {i}" for i in range(160)] + ["Boom at 03:28:22", "rare thing here"]
    rows = [("l", i + 1, t, "Event1" if i < 160 else f"Event{i - 158}") for i, t in enumerate(texts)]
    structured = spark.createDataFrame(rows, SCHEMA + ", EventId string")
    catalogue = spark.createDataFrame(
        [("l", "Event1", "ok <*>", 160), ("l", "Event2", "Boom", 1), ("l", "Event3", "rare", 1)],
        "log_id string, EventId string, EventTemplate string, Occurrences bigint",
    )
    asked = spark.createDataFrame(
        [(1, "What happened at 03:28:22?"), (2, "What is the event Event1 and Event2?"), (3, "Summarize the log."),
         (4, "Who are you?"), (5, "What is 'nothing' in this log?"), (6, "Which log line is the rare thing?")],
        "question_id bigint, question string",
    )
    lines = structured.select("log_id", "line_no", "line")
    found = {r.question_id: r for r in answer_questions(asked, lines, structured, catalogue).collect()}
    assert len(found) == 6
    assert found[1].context == ["Boom at 03:28:22"] and found[1].n_matched == 1 and not found[1].direct
    assert found[2].n_matched == 161 and found[2].trimmed and len(found[2].context) == 150
    assert found[2].context[:2] == ["ok 0", "ok 1"]
    assert found[3].n_matched == 3 and found[3].route == "All" and not found[3].direct
    assert found[4].direct and found[4].context == []
    assert found[5].direct and found[5].n_matched == 0
    assert found[6].route == "Partial > Retrieve" and "rare thing here" in found[6].context[0]


def test_exchanges(spark):
    turns = [(1, 0, "system", "s"), (1, 2, "user", "q1"), (1, 3, "assistant", "a1"), (1, 7, "user", "q2"),
             (1, 8, "user", "q3"), (1, 9000, "assistant", "a3"), (2, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.user_input, r.response) for r in conversations.exchanges(df).collect()}
    assert got == {(1, 2): ("q1", "a1"), (1, 7): ("q2", None), (1, 8): ("q3", "a3"), (2, 0): ("q", None)}
    timed = spark.createDataFrame([("abcd", 2.0)], "response string, elapsed double")
    row = conversations.exchange_metrics(timed).first()
    assert row.response_time == "2.00 seconds" and row.chars_per_second == 2.0


def test_exchange_note(spark):
    df = spark.createDataFrame(
        [("partial > search", ["a", "b"], [], 2.0, "abcde"), ("all", [], [], 1.0, "x")],
        "route string, k array<string>, e array<string>, t double, r string",
    )
    note = conversations.exchange_note(F.col("route"), F.col("k"), F.col("e"), F.col("t"), F.col("r"))
    assert [r.n for r in df.select(note.alias("n")).collect()] == [
        "Route: Partial > Search | Keywords: a, b | Time Taken: 2.00 s | Tokens/Second: 2.50",
        "Route: All | Time Taken: 1.00 s | Tokens/Second: 1.00",
    ]
