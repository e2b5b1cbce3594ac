from logweave.operators import routing
from logweave.operators.context import PromptFrames
from logweave.plans.answers import answer_questions, question_prompts

LINES = [("l", 1, "Boom here", "Event1"), ("l", 2, "Start of Bar", "Event2"), ("l", 3, "Boom there", "Event1")]
ASKED = {
    1: "What is the event Event1?",
    2: "Where is 'Bar' in the log?",
    3: "Summarize the log.",
    4: "Who are you?",
    5: "Which log line has Start in it?",
    6: "Where is 'Nowhere' in the log?",
}


def tables(spark):
    structured = spark.createDataFrame(LINES, "log_id string, line_no bigint, line string, EventId string")
    catalogue = spark.createDataFrame(
        [("l", "Event1", "Boom <*>", 2), ("l", "Event2", "Start of <*>", 1)],
        "log_id string, EventId string, EventTemplate string, Occurrences bigint",
    )
    asked = spark.createDataFrame(list(ASKED.items()), "question_id bigint, question string")
    return asked, structured.select("log_id", "line_no", "line"), structured, catalogue


def test_every_question_has_a_prompt_with_its_context(spark):
    found = {r.question_id: r.prompt for r in question_prompts(*tables(spark)).collect()}
    assert found.keys() == ASKED.keys()
    assert all(ASKED[n] in text and "null" not in text for n, text in found.items())
    assert "of these events: Event1\ntotal: 2\n" in found[1]
    assert "Event1,Boom <*>,2\n" in found[1] and "Boom here\nBoom there" in found[1] and "Event2" not in found[1]
    assert "any of these words: Bar\ntotal: 1\n\nStart of Bar\n" in found[2]
    assert "Event1,Boom <*>,2\nEvent2,Start of <*>,1\n" in found[3] and "begins with: Boom here" in found[3]
    assert "lines: 3\nkinds of events: 2\n" in found[3]
    assert "# Parts of the log\nBoom here\nStart of Bar" in found[5]
    assert "Boom" not in found[4] + found[6]


def test_frames_advice_and_catalogue_pages_are_parameters(spark):
    frames = PromptFrames(retrieve="%s~%s~%s", whole_advice=("Be brief.",))
    found = {r.question_id: r.prompt for r in question_prompts(*tables(spark), frames=frames, page_events=1).collect()}
    assert "~Which log line has Start in it?" in found[5]
    assert "# Please note\nBe brief.\n" in found[3] and "Event1,Boom <*>,2\n" in found[3] and "Event2" not in found[3]


def test_given_decisions_go_before_the_rules(spark):
    texts = {
        1: '{"choice": "search", "keywords": ["there", "there"]}',
        2: '{"choice": "event", "events": ["Event2"]}',
        3: "no json",
        4: '{"choice": "All"}',
        5: '{"choice": "search"}',
    }
    decisions = spark.createDataFrame(list(texts.items()), "question_id bigint, json string")
    decisions = routing.parse_route_json(decisions)
    found = {r.question_id: r for r in answer_questions(*tables(spark), decisions).collect()}
    routes = ["Partial > Search", "Partial > Event", "Generation", "All", "Partial > Search", "Partial > Search"]
    assert [found[n].route for n in sorted(found)] == routes
    assert found[1].context == ["Boom there"] and found[1].keywords == ["there"]
    assert found[2].context == ["Start of Bar"] and not found[2].direct
    assert found[3].direct and not found[4].direct and found[4].n_matched == 2
    assert found[5].direct and found[6].keywords == ["Nowhere"]
