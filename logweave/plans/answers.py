"""A batch of questions about one log, answered with the lines that bear on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators import context as texts_of
from logweave.operators import retrieval
from logweave.operators.routing import ALL, EVENT, PARTIAL, RETRIEVE, SEARCH, decided_questions, route_questions
from logweave.operators.search import EVENT_CAP, KEYWORD_CAP, KeywordSets, with_set_key
from logweave.session import lookup_join, materialize

_ANSWER = ["question_id", "n_matched", "trimmed", "context"]


def _ordered(place: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(place, "line")))
    return F.transform(pairs, lambda e: e["line"])


def search_answers(routed: DataFrame, lines: DataFrame) -> DataFrame:
    """Matches per distinct keyword set, handed to each question that asks for the set."""
    asked = with_set_key(routed.filter((F.col("level2") == SEARCH) & (F.size("keywords") > 0)))
    capped = KeywordSets(lines, asked).capped(KEYWORD_CAP)
    found = capped.groupBy("set_key").agg(
        F.max("n_matched").alias("n_matched"), F.max("trimmed").alias("trimmed"), _ordered("place").alias("context")
    )
    return lookup_join(asked, found, ["set_key"], "inner").select(*_ANSWER)


def event_answers(routed: DataFrame, structured: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Totals come from the catalogue; lines from the first ones of each event.

    The first lines of a set of events are among the first lines of its events, so an event
    named by many questions is read once.
    """
    asked = routed.filter(F.col("level2") == EVENT).withColumn(
        "set_key", F.array_join(F.array_sort("events"), ",")
    )
    sets = materialize(
        asked.select("set_key", F.explode("events").alias("EventId")).distinct(), "event_sets"
    )
    totals = sets.join(catalogue.select("EventId", "Occurrences"), "EventId").groupBy("set_key").agg(
        F.sum("Occurrences").alias("n_matched")
    )
    wanted = lookup_join(
        structured.select("EventId", "line_no", "line"),
        sets.select("EventId").distinct(),
        ["EventId"],
        "left_semi",
    )
    first = (
        wanted.withColumn("_place", F.row_number().over(W.partitionBy("EventId").orderBy("line_no")))
        .filter(F.col("_place") <= EVENT_CAP)
        .join(sets, "EventId")
        .withColumn("place", F.row_number().over(W.partitionBy("set_key").orderBy("line_no")))
        .filter(F.col("place") <= EVENT_CAP)
        .groupBy("set_key")
        .agg(_ordered("place").alias("context"))
    )
    found = first.join(totals, "set_key").withColumn("trimmed", F.col("n_matched") >= EVENT_CAP)
    return lookup_join(asked, found, ["set_key"], "inner").select(*_ANSWER)


def retrieved_answers(routed: DataFrame, lines: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
    """Chunks most similar to a question, by TF-IDF of their words."""
    asked = routed.filter(F.col("level2") == RETRIEVE).withColumn("query_id", F.xxhash64("question"))
    texts = asked.groupBy("query_id").agg(F.any_value("question").alias("text"))
    ids = materialize(retrieval.chunk_ids(lines), "chunks")
    chunks = materialize(
        retrieval.chunk_texts(lines, ids).withColumn("vec_id", F.col("line_from")), "chunk_texts"
    )
    best = retrieval.nearest_texts(chunks.select("vec_id", "text"), texts, k)
    found = (
        best.join(chunks.select("vec_id", F.col("text").alias("line")), "vec_id")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_matched"), F.lit(False).alias("trimmed"), _ordered("place").alias("context"))
    )
    return lookup_join(asked, found, ["query_id"], "inner").select(*_ANSWER)


def answer_questions(
    questions: DataFrame,
    lines: DataFrame,
    structured: DataFrame,
    catalogue: DataFrame,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """``(question_id, question, route, n_matched, trimmed, direct, context, keywords, events)``.

    All tables are about one log.  ``direct`` marks questions to answer without log lines:
    routed to no log, or nothing found.  Whole-log questions count the events; their context
    is the catalogue itself (``catalogue_pages``), which ``question_prompts`` attaches.  A router's
    ``decisions`` (see ``decided_questions``) go before the rules.
    """
    routed = route_questions(questions) if decisions is None else decided_questions(questions, decisions)
    routed = materialize(routed, "routed")
    partial = (
        search_answers(routed, lines)
        .unionByName(event_answers(routed, structured, catalogue))
        .unionByName(retrieved_answers(routed, lines))
    )
    n_events = catalogue.agg(F.count("*").alias("_n")).scalar()
    return (
        routed.join(partial, "question_id", "left")
        .withColumn(
            "n_matched",
            F.when(F.col("level1") == ALL, n_events).otherwise(F.coalesce("n_matched", F.lit(0))),
        )
        .select(
            "question_id",
            "question",
            "route",
            "n_matched",
            F.coalesce("trimmed", F.lit(False)).alias("trimmed"),
            ((F.col("level1") != ALL) & ((F.col("level1") != PARTIAL) | (F.col("n_matched") == 0))).alias("direct"),
            F.coalesce("context", F.array().cast("array<string>")).alias("context"),
            "keywords",
            "events",
        )
    )


def question_prompts(
    questions: DataFrame,
    lines: DataFrame,
    structured: DataFrame,
    catalogue: DataFrame,
    decisions: DataFrame | None = None,
    frames: texts_of.PromptFrames = texts_of.FRAMES,
    page_events: int | None = None,
) -> DataFrame:
    """``(question_id, route, prompt)``: the prompt of every question, with the context of its route.

    Whole-log questions get the catalogue, the log's first and last line and its counts (with ``page_events``
    the catalogue's first page, so that a prompt stays bounded); questions
    on events the events' catalogue rows and lines; the others their lines or chunks.  Direct
    questions are asked as they are.  All tables are about one log.
    """
    found = materialize(answer_questions(questions, lines, structured, catalogue, decisions), "answers")
    named = found.select("question_id", F.explode("events").alias("EventId")).join(catalogue, "EventId")
    rows = named.groupBy("question_id").agg(texts_of.events_text().alias("_rows"))
    whole = texts_of.summary_context(lines, catalogue).join(
        texts_of.catalogue_pages(catalogue, page_events).filter("page = 0").select("log_id", "events_text"), "log_id", "left"
    )
    route = F.lower(F.element_at(F.split("route", " > "), -1))
    asked = found.join(rows, "question_id", "left").withColumn("_route", route)
    whole = whole.withColumn("events_text", F.coalesce("events_text", F.lit(""))).withColumn("_route", F.lit(ALL))
    asked = lookup_join(asked, whole, ["_route"], "left")
    question, n_matched, trimmed, lines_of = F.col("question"), F.col("n_matched"), F.col("trimmed"), F.col("context")
    prompt = (
        F.when(F.col("direct") | ((F.col("_route") == ALL) & F.col("log_id").isNull()), texts_of.chat_prompt(question))
        .when(F.col("_route") == ALL, texts_of.summary_prompt(question, frames))
        .when(
            F.col("_route") == EVENT,
            texts_of.event_prompt(question, F.col("events"), n_matched, trimmed, EVENT_CAP, F.col("_rows"), lines_of, frames),
        )
        .when(F.col("_route") == RETRIEVE, texts_of.retrieve_prompt(question, lines_of, frames))
        .otherwise(
            texts_of.search_prompt(question, F.col("keywords"), n_matched, trimmed, KEYWORD_CAP, lines_of, frames)
        )
    )
    return asked.select("question_id", "route", prompt.alias("prompt"))
