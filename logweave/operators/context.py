"""Whole-log context and prompt texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.parsing import log_extent

# The system text and the marks of the chat format.
SYSTEM_PROMPT = (
    "You are a Log Analyst. Your goal is to answer questions as accurately as possible based on "
    "the instructions and context provided."
)
CHAT_FRAME = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n%s<|eot_id|>"
    "<|start_header_id|>user<|end_header_id|>\n\n%s<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n"
)


@dataclass(frozen=True)
class PromptFrames:
    """Texts around a question and its context; ``%s`` marks take the parts in the order named.

    ``advice`` lines end every prompt of their kind, so a caller can ask for citations or a style.
    """

    #: Log, lines, events, first line, last line, catalogue, advice, question.
    whole: str = (
        "# The log\nname: %s\nlines: %s\nkinds of events: %s\nbegins with: %s\nends with: %s\n\n"
        "# Its events (id, template, how often)\n%s\n\n# Please note\n%s\n\n# To answer\n%s\n"
    )
    #: Keywords, total, note on a cut, lines, advice, question.
    search: str = "# Lines with any of these words: %s\ntotal: %s%s\n\n%s\n\n# Please note\n%s\n\n# To answer\n%s\n"
    #: Events, total, note on a cut, catalogue rows, lines, advice, question.
    event: str = (
        "# Lines of these events: %s\ntotal: %s%s\n\n# The events (id, template, how often)\n%s\n\n"
        "# The lines\n%s\n\n# Please note\n%s\n\n# To answer\n%s\n"
    )
    #: Chunks, advice, question.
    retrieve: str = "# Parts of the log\n%s\n\n# Please note\n%s\n\n# To answer\n%s\n"
    cut: str = ", of which the first %s follow"
    whole_advice: tuple[str, ...] = (
        "The times of the first and the last line bound the period.",
        "Name the event ids that a statement rests on, and weigh events by how often they occur.",
    )
    lines_advice: tuple[str, ...] = ("A question of how many asks for the total, not for the lines shown.",)
    retrieve_advice: tuple[str, ...] = ("The parts were chosen by their words; the log holds more than them.",)


FRAMES = PromptFrames()


def summary_context(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(log_id, first_line, last_line, n_lines, n_events)``: one row per log."""
    events = catalogue.groupBy("log_id").agg(F.count("*").alias("n_events"))
    return log_extent(lines).join(events, "log_id", "left").withColumn(
        "n_events", F.coalesce("n_events", F.lit(0))
    )


def catalogue_pages(catalogue: DataFrame, page_events: int | None = None) -> DataFrame:
    """``(log_id, page, events_text)``: the catalogue as ``id,template,count`` lines.

    One text holds the whole catalogue, unless the caller sets how many events a page may hold.
    """
    number = F.substring("EventId", 6, 18).cast("bigint")
    return catalogue.groupBy("log_id", (F.floor((number - 1) / page_events) if page_events else F.lit(0)).alias("page")).agg(
        events_text().alias("events_text")
    )


def events_text() -> Column:
    """Aggregate: a group's catalogue rows as ``id,template,count`` lines in the order of their numbers."""
    number = F.substring("EventId", 6, 18).cast("bigint")
    row = F.concat_ws(",", "EventId", "EventTemplate", F.col("Occurrences").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct(number.alias("number"), row.alias("row"))))
    return F.array_join(F.transform(ordered, lambda e: e["row"]), "\n")


def chat_prompt(text: Column) -> Column:
    return F.format_string(CHAT_FRAME, F.lit(SYSTEM_PROMPT), text)


def _lines(advice: tuple[str, ...]) -> Column:
    return F.lit("\n".join(advice))


def _cut(trimmed: Column, cap: int, frames: PromptFrames) -> Column:
    return F.when(trimmed, F.lit(frames.cut % cap)).otherwise(F.lit(""))


def summary_prompt(question: Column, frames: PromptFrames = FRAMES) -> Column:
    """Prompt for a question on the whole log; the catalogue pages go where it says so."""
    parts = ["log_id", "n_lines", "n_events", "first_line", "last_line", "events_text"]
    return chat_prompt(
        F.format_string(frames.whole, *[F.col(part).cast("string") for part in parts], _lines(frames.whole_advice), question)
    )


def search_prompt(
    question: Column, keywords: Column, n_matched: Column, trimmed: Column, cap: int, context: Column, frames: PromptFrames = FRAMES
) -> Column:
    """Prompt for a question answered from matched lines."""
    return chat_prompt(
        F.format_string(
            frames.search,
            F.array_join(keywords, ", "),
            n_matched.cast("string"),
            _cut(trimmed, cap, frames),
            F.array_join(context, "\n"),
            _lines(frames.lines_advice),
            question,
        )
    )


def event_prompt(
    question: Column,
    events: Column,
    n_matched: Column,
    trimmed: Column,
    cap: int,
    rows: Column,
    context: Column,
    frames: PromptFrames = FRAMES,
) -> Column:
    """Prompt for a question answered from the lines of events, with the events' catalogue rows."""
    return chat_prompt(
        F.format_string(
            frames.event,
            F.array_join(events, ", "),
            n_matched.cast("string"),
            _cut(trimmed, cap, frames),
            rows,
            F.array_join(context, "\n"),
            _lines(frames.lines_advice),
            question,
        )
    )


def retrieve_prompt(question: Column, context: Column, frames: PromptFrames = FRAMES) -> Column:
    """Prompt for a question answered from chunks of the log."""
    return chat_prompt(
        F.format_string(frames.retrieve, F.array_join(context, "\n"), _lines(frames.retrieve_advice), question)
    )
