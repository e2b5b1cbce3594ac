"""Rules that send a question to the part of the log it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the routes on both levels.
ALL, PARTIAL, GENERATION = "all", "partial", "generation"
SEARCH, EVENT, RETRIEVE = "search", "event", "retrieve"
ROUTES = (ALL, PARTIAL, GENERATION, SEARCH, EVENT, RETRIEVE)

# What the rules look for; written for both Java and RE2.
WHOLE_LOG = r"(?i)summar|report|overview|anomal|abnormal|entire log|whole log"
LOG_TOPIC = r"(?i)\blogs?\b|\blogged\b|\blogin\b|log file|log on|\bevents?\b|\blines?\b|\boccur"
EVENT_NAME = r"(?i)\bevent ?(\d+)\b"
CLOCK_TIME = r"\d{2}:\d{2}:\d{2}"
# Quotes count at the edges of words only, so that an apostrophe inside a word is none.
QUOTED = r"\B'([^']+)'\B"
DOUBLE_QUOTED = r"\B\"([^\"]+)\"\B"

ROUTE_SCHEMA = "choice string, keywords array<string>, events array<string>"


def question_keywords(question: Column) -> Column:
    """Strings in single quotes, then in double quotes, then clock times, each once."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(question, F.lit(QUOTED), F.lit(1)),
            F.regexp_extract_all(question, F.lit(DOUBLE_QUOTED), F.lit(1)),
            F.regexp_extract_all(question, F.lit(CLOCK_TIME), F.lit(0)),
        )
    )


def question_events(question: Column) -> Column:
    """Event names in canonical spelling, each once."""
    numbers = F.regexp_extract_all(question, F.lit(EVENT_NAME), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("Event"), n)))


def _quoted(question: Column) -> Column:
    return question.rlike(QUOTED) | question.rlike(DOUBLE_QUOTED)


def first_route(question: Column) -> Column:
    """Whole log, part of the log, or no log; what is quoted does not speak of the whole log."""
    unquoted = F.regexp_replace(F.regexp_replace(question, QUOTED, " "), DOUBLE_QUOTED, " ")
    partial = (
        question.rlike(EVENT_NAME)
        | question.rlike(CLOCK_TIME)
        | _quoted(question)
        | question.rlike(LOG_TOPIC)
    )
    return (
        F.when(unquoted.rlike(WHOLE_LOG), F.lit(ALL))
        .when(partial, F.lit(PARTIAL))
        .otherwise(F.lit(GENERATION))
    )


def second_route(question: Column) -> Column:
    """By event name, by keyword, or by similarity."""
    return (
        F.when(question.rlike(EVENT_NAME), F.lit(EVENT))
        .when(_quoted(question) | question.rlike(CLOCK_TIME), F.lit(SEARCH))
        .otherwise(F.lit(RETRIEVE))
    )


def route_questions(questions: DataFrame) -> DataFrame:
    """Add ``level1``, ``level2``, ``keywords``, ``events`` and the title-cased ``route``."""
    question = F.col("question")
    partial = F.col("level1") == PARTIAL
    nothing = F.array().cast("array<string>")
    return (
        questions.withColumn("level1", first_route(question))
        .withColumn("level2", F.when(partial, second_route(question)))
        .withColumn("keywords", F.when(F.col("level2") == SEARCH, question_keywords(question)).otherwise(nothing))
        .withColumn("events", F.when(F.col("level2") == EVENT, question_events(question)).otherwise(nothing))
        .withColumn("route", F.initcap(F.concat_ws(" > ", "level1", "level2")))
    )


def parse_route_json(answers: DataFrame, column: str = "json") -> DataFrame:
    """Read a router's JSON answer.

    ``usable`` says whether the choice is a route; a malformed answer gives null, and neither it
    nor an unknown choice is usable: such questions are answered without the log.
    """
    parsed = F.from_json(F.col(column), ROUTE_SCHEMA)
    return (
        answers.withColumn("_route", parsed)
        .withColumn("choice", F.col("_route.choice"))
        .withColumn("keywords", F.col("_route.keywords"))
        .withColumn("events", F.col("_route.events"))
        .withColumn("usable", F.coalesce(F.lower("choice").isin(*ROUTES), F.lit(False)))
        .drop("_route")
    )


def decided_questions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``route_questions`` with given decisions in place of the rules.

    ``decisions`` has question_id and what ``parse_route_json`` reads: choice, keywords, events,
    usable.  A decision that is not usable leaves the question without the log; a question
    without a decision is routed by the rules.  A choice of ``partial`` alone gets the rules' second
    level, keywords and events.  Of several decisions for a question the smallest counts.
    """
    given = decisions.groupBy("question_id").agg(F.min(F.struct("choice", "keywords", "events", "usable")).alias("_given"))
    choice = F.when(F.col("_given.usable"), F.lower("_given.choice")).otherwise(F.lit(GENERATION))
    question, nothing = F.col("question"), F.array().cast("array<string>")
    names = lambda column: F.coalesce(F.array_distinct(F.array_compact(column)), nothing)
    level2 = F.when(F.col("_choice").isin(SEARCH, EVENT, RETRIEVE), F.col("_choice")).when(
        F.col("_choice") == PARTIAL, second_route(question)
    )
    ruled = F.col("_given").isNull()
    alone = F.col("_choice") == PARTIAL
    own = lambda route, found, column: F.when(
        F.col("_level2") == route, F.when(alone, found).otherwise(names(F.col(column)))
    ).otherwise(nothing)
    routed = route_questions(questions).join(given, "question_id", "left").withColumn("_choice", choice)
    routed = routed.withColumn("_level2", level2)
    return (
        routed.withColumn("keywords", F.when(ruled, F.col("keywords")).otherwise(own(SEARCH, question_keywords(question), "_given.keywords")))
        .withColumn("events", F.when(ruled, F.col("events")).otherwise(own(EVENT, question_events(question), "_given.events")))
        .withColumn(
            "level1",
            F.when(ruled, F.col("level1")).when(F.col("_level2").isNotNull(), F.lit(PARTIAL)).otherwise(F.col("_choice")),
        )
        .withColumn("level2", F.when(ruled, F.col("level2")).otherwise(F.col("_level2")))
        .withColumn("route", F.initcap(F.concat_ws(" > ", "level1", "level2")))
        .drop("_given", "_choice", "_level2")
    )
