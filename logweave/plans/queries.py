"""The registered queries: each takes ``(spark, folder)`` and returns a DataFrame.

All of them read the tables in ``folder``, or log lines, questions and answers that Spark
renders from every row of those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators import (
    accuracy,
    context,
    conversations,
    detection,
    mining,
    parsing,
    reports,
    retrieval,
    routing,
    scoring,
    search,
    templates,
)
from logweave.operators.gram_index import GramIndex
from logweave.operators.vectors import VectorIndex, nearest, recall
from logweave.plans.answers import answer_questions, question_prompts
from logweave.plans.log_analysis import analyse, keep_line
from logweave.session import lookup_join, materialize, scratch_path
from logweave.sources import rendered, tables
from logweave.sources.lines import read_log_lines
from logweave.streaming import mining as online

Query = Callable[[SparkSession, str], DataFrame]

FORMAT = "Spark"
IP_MASK = r"(\d+\.){3}\d+"
NUMBER_MASK = r"\b\d+(\.\d+)?\b"
MASKS = (IP_MASK, NUMBER_MASK)
KEYWORDS = ("ERROR", "10.0.46.", "error", "{\"k\": 8")
EVENTS = ("Event2", "Event7", "Event9", "Event99")
TEXT_FILE_LINES = 100_000
# Folder name of a missing value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
BASELINE = "model-0"
MODELS = [f"model-{i}" for i in range(5)]
ANSWER_MODELS = ["copy", "bench", "joined", "labelled"]
ANSWER_IDS = ["sheet", "question_id", "category"]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return rendered.event_log_lines(spark, folder)


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_lines(keep_line(_lines(spark, folder)), FORMAT)


def _masked(spark: SparkSession, folder: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    return templates.masked_lines(_parsed(spark, folder), masks)


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return templates.catalogue(_masked(spark, folder))


def _structured(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Structured lines with their raw text, and the catalogue."""
    masked = materialize(_masked(spark, folder), "masked")
    events = materialize(templates.catalogue(masked), "catalogue")
    return templates.attach_events(masked, events).withColumnRenamed("raw", "line"), events


def _tokens(text: str) -> Column:
    return T.tokens(F.col(text))


def _joined(items: str, mark: str = "|") -> Column:
    return F.array_join(F.col(items), mark)


# Lines and parsing


@query
def read_text_log(spark, folder):
    """Lines written as text files, some per day, and every line read back with its place in the day."""
    path = scratch_path(spark, "text")
    lines = _lines(spark, folder).withColumn("day", F.substring("line", 1, 10))
    # A file holds the lines of a day in one range of numbers, in order.
    part = F.floor(F.col("line_no") / TEXT_FILE_LINES)
    lines.withColumn("part", part).repartition("day", "part").sortWithinPartitions("day", "part", "line_no").select(
        "line", "day", "part"
    ).write.partitionBy("day", "part").text(path)
    return _day_places(read_log_lines(spark, path))


def _day_places(found: DataFrame) -> DataFrame:
    """``(day, place, line)`` of lines in files ``day=<day>/part=<number>/…``: a file goes on where the day's earlier ones end."""
    found = found.select(
        F.regexp_extract("log_id", "^day=([^/]*)/", 1).alias("_day"), F.regexp_extract("log_id", "/part=([^/]*)/", 1).alias("_part"),
        "line_no", "line",
    )
    before = W.partitionBy("_day").orderBy(F.asc_nulls_last(F.col("_part").try_cast("bigint"))).rowsBetween(W.unboundedPreceding, -1)
    offsets = found.groupBy("_day", "_part").agg(F.count("*").alias("_lines")).select(
        "_day", "_part", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")
    )
    # A line without a day is null, which a text file cannot tell from an empty line.
    day = F.nullif("_day", F.lit(NO_VALUE))
    return lookup_join(found, offsets, ["_day", "_part"]).select(
        day.alias("day"), (F.col("_before") + F.col("line_no")).alias("place"), F.when(day.isNotNull(), F.col("line")).alias("line")
    )


@query
def parse_lines(spark, folder):
    return _parsed(spark, folder).select("line_no", "Date", "Time", "Level", "Component", "Content")


@query
def line_ids(spark, folder):
    return parsing.with_line_ids(_parsed(spark, folder)).select("line_no", F.col("LineId").cast("bigint"))


@query
def rejected_lines(spark, folder):
    return parsing.rejected_lines(_lines(spark, folder), FORMAT).select("line_no", "line")


@query
def coverage(spark, folder):
    return parsing.coverage(_lines(spark, folder), FORMAT)


@query
def log_extent(spark, folder):
    return parsing.log_extent(_lines(spark, folder))


@query
def sample_lines(spark, folder):
    return parsing.sample_lines(_lines(spark, folder), 10).select("line_no", "line")


@query
def format_scores(spark, folder):
    """How many lines look like each of the known formats."""
    return detection.format_scores(_lines(spark, folder))


@query
def detect_format(spark, folder):
    """The format of each of sixteen logs, one in every known layout."""
    return detection.detect_format(materialize(rendered.layout_log_lines(spark, folder), "layout_lines"))


@query
def parse_detected(spark, folder):
    """Sixteen logs, each parsed with the format found for it."""
    lines = materialize(rendered.layout_log_lines(spark, folder), "layout_lines")
    parsed = detection.parse_detected(lines, detection.detect_format(lines))
    return parsed.select(
        "log_id", "line_no", "format", "content", F.try_element_at("headers", F.lit("Level")).alias("level"),
        F.size("headers").cast("bigint").alias("n_headers"),
    )


# Templates


@query
def mask_templates(spark, folder):
    return _masked(spark, folder).groupBy("template").agg(F.count("*").alias("n_lines"))


@query
def tokenise(spark, folder):
    found = _parsed(spark, folder).select("line_no", _tokens("Content").alias("tokens"))
    return found.select("line_no", F.size("tokens").cast("bigint").alias("n_tokens"), _joined("tokens").alias("tokens"))


@query
def digit_tokens(spark, folder):
    found = _parsed(spark, folder).select("line_no", _tokens("Content").alias("tokens"))
    return found.select(
        "line_no", F.array_join(F.filter("tokens", T.has_digit), "|").alias("digit_tokens")
    )


@query
def event_catalogue(spark, folder):
    return _catalogue(spark, folder).select(
        "EventId", "EventTemplate", "Occurrences", "first_line", "template_key"
    )


@query
def structured_log(spark, folder):
    structured, _ = _structured(spark, folder)
    return structured.select("line_no", "Level", "Component", "EventId", "EventTemplate")


@query
def param_list(spark, folder):
    structured, events = _structured(spark, folder)
    return templates.with_parameters(structured, events).select(
        "line_no", "EventId", F.size("ParameterList").cast("bigint").alias("n_parameters"),
        _joined("ParameterList").alias("parameters"),
    )


@query
def template_similarity(spark, folder):
    """Similarity of each line, addresses masked, to the template of its event."""
    structured, _ = _structured(spark, folder)
    own = F.split(T.template_text(F.col("Content"), (IP_MASK,)), " ")
    return structured.select(
        "line_no", F.round(T.similarity(F.split("EventTemplate", " "), own), 6).alias("similarity")
    )


@query
def template_match(spark, folder):
    """Lines, addresses masked, matched to the catalogue of fully masked templates."""
    lines = _masked(spark, folder, (IP_MASK,)).select("log_id", "line_no", "template", "n_tokens")
    events = materialize(_catalogue(spark, folder), "catalogue")
    return templates.match_catalogue(lines, events, 0.5).select(
        "line_no", "EventId", F.round("similarity", 6).alias("similarity")
    )


@query
def template_merge(spark, folder):
    """Templates of one length and first token merged into one."""
    masked = _masked(spark, folder, (IP_MASK,)).withColumn("first_token", F.split_part("template", F.lit(" "), F.lit(1)))
    merged = templates.group_templates(masked, ["n_tokens", "first_token"])
    return merged.select(F.col("n_tokens").cast("bigint"), "first_token", "merged_template", "n_lines")


@query
def mine_templates(spark, folder):
    """Catalogue of templates mined from the lines in order."""
    masked = _masked(spark, folder, (IP_MASK,))
    found = mining.mine_assignments(masked.select("log_id", "line_no", "template", "n_tokens"), 0.5, 4)
    return mining.mined_catalogue(found).select("EventId", "EventTemplate", "Occurrences", "first_line", "template_key")


@query
def mined_lengths(spark, folder):
    """Mined templates keep the number of tokens: lines and first line per length."""
    masked = _masked(spark, folder, (IP_MASK,))
    found = mining.mine_assignments(masked.select("log_id", "line_no", "template", "n_tokens"), 0.5, 4)
    length = T.token_count(F.col("EventTemplate")).cast("bigint").alias("n_tokens")
    return mining.mined_catalogue(found).groupBy(length).agg(
        F.sum("Occurrences").alias("n_lines"), F.min("first_line").alias("first_line")
    )


@query
def mined_log(spark, folder):
    """Every line with its mined event and parameters."""
    found = analyse(_lines(spark, folder), FORMAT)
    return found.structured.select(
        "line_no", F.col("LineId").cast("bigint").alias("LineId"), "EventId", "EventTemplate",
        _joined("ParameterList").alias("parameters"),
    )


@query
def parsing_accuracy(spark, folder):
    """Mined events against the four kinds of lines that were rendered."""
    masked = _masked(spark, folder, (IP_MASK,)).select("log_id", "line_no", "template", "n_tokens")
    masked = materialize(masked, "masked")
    found = mining.attach_mined(masked, mining.mine_assignments(masked, 0.5, 4))
    known = found.withColumn("kind", (F.col("line_no") - 1) % 4)
    return _rounded(accuracy.parsing_accuracy(known, "kind", "template", ["log_id"]))


@query
def mined_stream(spark, folder):
    """Lines that arrive in four parts, mined part by part with state in between."""
    masked = _masked(spark, folder, (IP_MASK,)).select("log_id", "line_no", "template", "n_tokens")
    masked = materialize(masked, "masked")
    last = masked.agg(F.max("line_no")).scalar()
    root = scratch_path(spark, "stream")
    own = spark.newSession()
    own.conf.set(online.STATE_STORE, online.ROCKS_DB)
    part = F.floor((F.col("line_no") - 1) * 4 / last)
    for number in range(4):
        masked.filter(part == number).write.parquet(f"{root}/in/part={number}")
        arrived = own.readStream.schema(masked.schema).parquet(f"{root}/in/part=*")
        mined = online.mine_stream(arrived, 0.5, 4)
        online.write_mined(mined, f"{root}/out", f"{root}/check", availableNow=True).awaitTermination()
    return online.mined_lines(spark, f"{root}/out").select("line_no", F.col("template").alias("EventTemplate"))


# Search


@query
def keyword_search(spark, folder):
    return search.keyword_search(_lines(spark, folder), KEYWORDS).select("line_no", "line")


@query
def capped_search(spark, folder):
    found = search.keyword_search(_lines(spark, folder), ("app.error",))
    return search.cap_matches(found, ["log_id"], search.KEYWORD_CAP).select(
        "place", "line_no", "line", "n_matched", "trimmed"
    )


@query
def keyword_search_batch(spark, folder):
    """Capped keyword search for every question that names keywords."""
    asked = routing.route_questions(rendered.log_questions(spark, folder)).filter(F.size("keywords") > 0)
    asked = materialize(search.with_set_key(asked), "asked")
    capped = search.KeywordSets(_lines(spark, folder), asked).capped(search.KEYWORD_CAP)
    per_set = capped.groupBy("set_key").agg(
        F.max("n_matched").alias("n_matched"), F.count("*").alias("n_shown"), F.max("trimmed").alias("trimmed"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
    )
    found = asked.select("question_id", "set_key").join(per_set, "set_key", "left").drop("set_key")
    return found.fillna({"n_matched": 0, "n_shown": 0, "trimmed": False})


@query
def keyword_matches(spark, folder):
    """Every line of every distinct keyword set that the questions ask for, through a gram index."""
    asked = routing.route_questions(rendered.log_questions(spark, folder)).filter(F.size("keywords") > 0)
    lines = _lines(spark, folder)
    index = GramIndex(spark, scratch_path(spark, "gram-index")).build(lines)
    found = search.KeywordSets(lines, asked, index=index).matches()
    return found.select(F.replace("set_key", F.lit("\u0001"), F.lit("|")).alias("keywords"), "line_no", "line")


@query
def event_search(spark, folder):
    structured, _ = _structured(spark, folder)
    return search.event_search(structured, EVENTS).select("line_no", "EventId", "line")


@query
def event_lookup(spark, folder):
    return search.event_lookup(_catalogue(spark, folder), EVENTS).select("EventId", "EventTemplate", "Occurrences")


@query
def event_lines(spark, folder):
    structured, _ = _structured(spark, folder)
    return search.event_lines(structured).select("EventId", F.col("place").cast("bigint").alias("place"), "line_no", "line")


@query
def event_pages(spark, folder):
    """Lines per event in lists of at most 1000."""
    structured, _ = _structured(spark, folder)
    return search.event_pages(structured, 1000).select(
        "EventId", F.col("page").cast("bigint").alias("page"), F.size("lines").cast("bigint").alias("n_lines"),
        F.md5(_joined("lines", "\n")).alias("lines_md5"),
    )


@query
def event_mentions(spark, folder):
    answers = rendered.event_answers(spark, folder)
    return search.mentions(answers).select("conv_id", "turn", F.col("place").cast("bigint").alias("place"), "EventId")


@query
def mention_lines(spark, folder):
    structured, _ = _structured(spark, folder)
    found = search.mention_lines(rendered.event_answers(spark, folder), structured)
    return found.select("EventId", "line_no", "line", "n_mentions")


# Chunks and vectors


@query
def chunks(spark, folder):
    found = retrieval.chunk_spans(_lines(spark, folder))
    return found.select("line_from", "line_to", "n_lines", "n_tokens")


@query
def chunk_texts(spark, folder):
    lines = _lines(spark, folder)
    found = retrieval.chunk_texts(lines, retrieval.chunk_ids(lines))
    return found.select("line_from", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query
def chunk_vectors(spark, folder):
    """TF-IDF weights of the words of documents."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    blocks, n_texts = retrieval.text_blocks(documents, "doc_id")
    weights = retrieval.block_weights(blocks, retrieval.block_words(blocks, "doc_id"), "doc_id", n_texts)
    return weights.select("doc_id", F.col("bucket").alias("word"), F.round("weight", 6).alias("weight"))


@query
def vector_topk(spark, folder):
    """Vectors nearest to the mean vector of each label."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    parts = vectors.select("label", F.posexplode("embedding").alias("place", "x"))
    means = parts.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("vector")
    )
    found = nearest(
        vectors.select("vec_id", F.col("embedding").alias("vector")), queries, 5, query_id="label"
    )
    return found.select("label", "vec_id", "place", F.round("score", 5).alias("score"))


@query
def vector_index(spark, folder):
    """Every twentieth vector looked up in an index of all, and whether at least nine in ten exact neighbours are found."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, scratch_path(spark, "vector-index")).build(vectors)
    found = materialize(index.nearest(asked, 10), "indexed")
    enough = recall(found, nearest(vectors, asked, 10)) >= 0.9
    return found.groupBy("query_id").agg(
        F.count("*").alias("n_found"),
        F.min_by("vec_id", "place").alias("first_id"),
        F.lit(enough).alias("enough"),
    )


# Context, routing, answers


@query
def summary_context(spark, folder):
    return context.summary_context(_lines(spark, folder), _catalogue(spark, folder))


@query
def catalogue_pages(spark, folder):
    return context.catalogue_pages(_catalogue(spark, folder)).select(F.col("page").cast("bigint"), "events_text")


@query
def route_l1(spark, folder):
    return rendered.log_questions(spark, folder).select(
        "question_id", routing.first_route(F.col("question")).alias("choice")
    )


@query
def route_l2(spark, folder):
    routed = routing.route_questions(rendered.log_questions(spark, folder))
    return routed.filter(F.col("level1") == routing.PARTIAL).select(
        "question_id", F.col("level2").alias("choice"), _joined("keywords").alias("keywords"),
        _joined("events").alias("events"), "route",
    )


@query
def router_json(spark, folder):
    """Router answers as JSON text, some of them malformed, read back."""
    routed = routing.route_questions(rendered.log_questions(spark, folder))
    text = F.to_json(F.struct(F.coalesce("level2", "level1").alias("choice"), "keywords", "events"))
    broken = F.when(F.col("level1") == routing.GENERATION, F.col("question")).otherwise(text)
    found = routing.parse_route_json(routed.select("question_id", broken.alias("json")))
    return found.select(
        "question_id", "choice", _joined("keywords").alias("keywords"), _joined("events").alias("events"), "usable"
    )


def _log_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, lines, structured lines and catalogue of the rendered log."""
    structured, events = _structured(spark, folder)
    return rendered.log_questions(spark, folder), _lines(spark, folder), structured, events


def _answered(found: DataFrame) -> DataFrame:
    return found.select(
        "question_id", "route", "n_matched", "trimmed", "direct",
        F.size("context").cast("bigint").alias("n_context"), F.md5(_joined("context", "\n")).alias("context_md5"),
        _joined("keywords").alias("keywords"), _joined("events").alias("events"),
    )


def _decisions(questions: DataFrame) -> DataFrame:
    """A router's answers as JSON for every fifth question, of three choices in turn."""
    turn = F.col("question_id") % 15
    json = (
        F.when(turn == 0, '{"choice": "search", "keywords": ["purchase", "User 1", "purchase"]}')
        .when(turn == 5, '{"choice": "event", "events": ["Event2", "Event5"]}')
        .otherwise('{"choice": "all"}')
    )
    return routing.parse_route_json(questions.filter("question_id % 5 = 0").select("question_id", json.alias("json")))


@query
def dispatch(spark, folder):
    """Every question answered with the lines, events or chunks that bear on it."""
    return _answered(answer_questions(*_log_parts(spark, folder)))


@query
def dispatch_decided(spark, folder):
    """The same where a router's decisions go before the rules."""
    parts = _log_parts(spark, folder)
    return _answered(answer_questions(*parts, _decisions(parts[0])))


@query
def prompts(spark, folder):
    """The prompt of every question on every route, with the context of its route."""
    found = question_prompts(*_log_parts(spark, folder))
    return found.select("question_id", "route", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))


@query
def summary_prompts(spark, folder):
    """Whole-log prompts for the questions that need the whole log."""
    events = materialize(_catalogue(spark, folder), "catalogue")
    whole = context.summary_context(_lines(spark, folder), events)
    pages = context.catalogue_pages(events)
    asked = rendered.log_questions(spark, folder).filter(
        routing.first_route(F.col("question")) == routing.ALL
    )
    prompt = context.summary_prompt(F.col("question"))
    asked = asked.withColumn("log_id", F.lit("events.log"))
    return asked.join(whole, "log_id").join(pages, "log_id").select(
        "question_id", F.col("page").cast("bigint").alias("page"), prompt.alias("prompt")
    )


@query
def exchanges(spark, folder):
    return conversations.exchanges(spark.read.parquet(f"{folder}/conversations.parquet"))


@query
def exchange_metrics(spark, folder):
    """Response time and characters per second, with a time that follows the question's length."""
    found = conversations.exchanges(spark.read.parquet(f"{folder}/conversations.parquet"))
    timed = found.withColumn("elapsed", (F.length("user_input") + 100) / 64.0)
    return conversations.exchange_metrics(timed).select(
        "conv_id", "turn", "response_time", F.round("chars_per_second", 6).alias("chars_per_second")
    )


@query
def saved_exchanges(spark, folder):
    """Exchanges with their notes, appended to a JSON-lines table in two writes and read back."""
    found = conversations.exchanges(spark.read.parquet(f"{folder}/conversations.parquet"))
    routed = routing.route_questions(
        found.withColumn("elapsed", (F.length("user_input") + 100) / 64.0).withColumn("question", F.col("user_input"))
    )
    note = conversations.exchange_note(
        F.col("route"), F.col("keywords"), F.col("events"), F.col("elapsed"), F.coalesce("response", F.lit(""))
    )
    records = routed.select(
        "user_input", "response", note.alias("extra_info"),
        F.lit("2024-01-01 00:00:00").alias("timestamp"), F.lit("1.00 seconds").alias("response_time"),
    )
    path = scratch_path(spark, "exchanges")
    tables.append_exchanges(records.filter(F.col("response").isNotNull()), path)
    tables.append_exchanges(records.filter(F.col("response").isNull()), path)
    return tables.read_exchanges(spark, path).select("user_input", "response", "extra_info", "timestamp", "response_time")


# Sinks


@query
def structured_roundtrip(spark, folder):
    """Structured log written as parquet per log and read back."""
    structured, events = _structured(spark, folder)
    full = templates.with_parameters(structured, events)
    root = scratch_path(spark, "results")
    tables.write_by_log(full, root, "structured")
    return tables.read_by_log(spark, root, "structured").select(
        "log_id", "line_no", "EventId", "Content", _joined("ParameterList").alias("parameters")
    )


@query
def replaced_results(spark, folder):
    """Results of two logs, of which one is then replaced; the other stays."""
    structured, _ = _structured(spark, folder)
    halves = structured.withColumn("log_id", F.when(F.col("line_no") % 2 == 0, "even.log").otherwise("odd.log"))
    root = scratch_path(spark, "results")
    tables.write_by_log(halves.select("log_id", "line_no", "EventId"), root, "structured")
    again = halves.filter("log_id = 'odd.log' and Level = 'ERROR'")
    tables.write_by_log(again.select("log_id", "line_no", "EventId"), root, "structured")
    return tables.read_by_log(spark, root, "structured").select("log_id", "line_no", "EventId")


@query
def catalogue_csv(spark, folder):
    """Catalogue written as CSV and read back with its schema."""
    path = scratch_path(spark, "catalogue")
    tables.write_csv(_catalogue(spark, folder), path)
    return tables.read_csv(spark, path, tables.CATALOGUE_SCHEMA)


@query
def metric_files(spark, folder):
    """Wide metrics written as one CSV folder per sheet, read back and made long."""
    wide = reports.pivot_by_category(_metrics(spark, folder), MODELS)
    path = scratch_path(spark, "metrics")
    tables.write_metrics(wide.drop("position"), path)
    names = [f"{model} {metric}" for model in MODELS for metric in reports.METRICS]
    return reports.wide_to_metrics(tables.read_metrics(spark, path, names))


# Scores


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    wide = rendered.document_answers(spark, folder, reports.CATEGORIES)
    return scoring.answers_long(scoring.finished_sheets(wide), [*ANSWER_IDS, "expected"], ANSWER_MODELS)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_answers(_answers(spark, folder), [*ANSWER_IDS, "model"])


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rendered.document_metrics(spark, folder, reports.CATEGORIES, reports.METRICS)


@query
def answers_long(spark, folder):
    return _answers(spark, folder).select(*ANSWER_IDS, "model", F.md5("answer").alias("answer_md5"))


@query
def normalise_text(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select("doc_id", F.md5(scoring.normalise(F.col("text"))).alias("text_md5"))


@query
def tfidf_cosine(spark, folder):
    return _scores(spark, folder).select("question_id", "model", F.round("cosine", 6).alias("cosine"))


@query
def rouge1(spark, folder):
    return _scores(spark, folder).select("question_id", "model", F.round("rouge1", 6).alias("rouge1"))


@query
def mean_scores(spark, folder):
    means = scoring.mean_scores(_scores(spark, folder))
    return means.select(
        "sheet", "model", "category", F.round(scoring.COSINE, 6).alias("cosine"), F.round(scoring.ROUGE, 6).alias("rouge1")
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{name}`"), 6).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


@query
def pivot_by_model(spark, folder):
    return _rounded(reports.pivot_by_model(_metrics(spark, folder)))


@query
def melt_metrics(spark, folder):
    return _rounded(scoring.melt_metrics(scoring.mean_scores(_scores(spark, folder))))


@query
def pivot_by_category(spark, folder):
    return _rounded(reports.pivot_by_category(_metrics(spark, folder), MODELS))


# Reports


@query
def mean_reports(spark, folder):
    """Means per cell, per category and per model from one scan."""
    return _rounded(reports.mean_reports(_metrics(spark, folder)))


@query
def category_mean(spark, folder):
    return reports.category_mean(_metrics(spark, folder))


@query
def improvement(spark, folder):
    means = reports.category_mean(_metrics(spark, folder))
    return _rounded(reports.improvement(means, BASELINE, ["category", "metric"]))


@query
def category_improvement(spark, folder):
    return reports.category_improvement(reports.category_mean(_metrics(spark, folder)), BASELINE)


@query
def top_categories(spark, folder):
    means = reports.category_mean(_metrics(spark, folder))
    ranked = reports.category_ranking(reports.category_improvement(means, BASELINE))
    return _rounded(ranked.filter(F.col("place") <= 3))


@query
def total_improvement(spark, folder):
    means = reports.category_mean(_metrics(spark, folder))
    return _rounded(reports.total_improvement(reports.category_improvement(means, BASELINE)))


@query
def model_means(spark, folder):
    return _rounded(reports.model_means(_metrics(spark, folder)))


@query
def overall_improvement(spark, folder):
    return _rounded(reports.overall_improvement(_metrics(spark, folder), BASELINE))


@query
def task_ranking(spark, folder):
    return _rounded(reports.task_ranking(_metrics(spark, folder), BASELINE))


@query
def iqr(spark, folder):
    return _rounded(reports.iqr(_metrics(spark, folder), ["model", "metric"]))


@query
def median(spark, folder):
    return _rounded(reports.medians(_metrics(spark, folder), ["model", "metric"]))


@query
def outliers(spark, folder):
    """Document lengths outside the fences of their language."""
    return _rounded(reports.outliers(_lengths(spark, folder), ["category"]).drop("sheet"))


@query
def outlier_share(spark, folder):
    return _rounded(reports.outlier_share(_lengths(spark, folder), ["category"]))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select(
        F.col("source").alias("sheet"), F.col("lang").alias("category"), "doc_id",
        F.col("n_chars").cast("double").alias("value"),
    )


@query
def iqr_narrowing(spark, folder):
    return _rounded(reports.iqr_narrowing(_metrics(spark, folder), BASELINE))


@query
def category_robustness(spark, folder):
    return _rounded(reports.category_robustness(_metrics(spark, folder), BASELINE))


@query
def final_robustness(spark, folder):
    return _rounded(reports.final_robustness(_metrics(spark, folder), BASELINE))


@query
def plot_inputs(spark, folder):
    return _rounded(reports.box_stats(_metrics(spark, folder), ["category", "model", "metric"]))
