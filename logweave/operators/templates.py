"""Templates over parsed lines: masking, catalogue, matching, merging, parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.formats import WILDCARD
from logweave.functions import text as T
from logweave.session import lookup_join, materialize
from logweave.sources.lines import contiguous_ids

# Events compared in one row of a match; bounds the list a row carries.
LIST_EVENTS = 256


def masked_lines(parsed: DataFrame, masks: Iterable[str], content: str = "Content") -> DataFrame:
    """Add ``template``: the masked content with single blanks, and ``n_tokens``."""
    masked = parsed.withColumn("template", T.template_text(F.col(content), masks))
    return masked.withColumn("n_tokens", T.token_count(F.col("template")))


def catalogue(templated: DataFrame) -> DataFrame:
    """``(log_id, EventId, EventTemplate, Occurrences, first_line, template_key)``.

    Counts are combined before the shuffle, so a template that holds most lines is one row
    per task.  Events are numbered by the first line of their template.
    """
    found = templated.groupBy("log_id", "template").agg(
        F.count("*").alias("Occurrences"), F.min("line_no").alias("first_line")
    )
    return number_events(found)


def number_events(found: DataFrame) -> DataFrame:
    """Name templates ``Event1, Event2 …`` per log in order of first appearance.

    The templates are written first: numbering reads them twice, and the lines only once.
    """
    return contiguous_ids(materialize(found, "templates"), "log_id", "first_line", "_number").select(
        "log_id",
        F.concat(F.lit("Event"), F.col("_number").cast("string")).alias("EventId"),
        F.col("template").alias("EventTemplate"),
        "Occurrences",
        "first_line",
        F.substring(F.md5("template"), 1, 8).alias("template_key"),
    )


def attach_events(templated: DataFrame, events: DataFrame) -> DataFrame:
    """Give each line its ``EventId`` and ``EventTemplate``."""
    names = events.select("log_id", F.col("EventTemplate").alias("template"), "EventId")
    return lookup_join(templated, names, ["log_id", "template"]).withColumnRenamed(
        "template", "EventTemplate"
    )


def with_parameters(structured: DataFrame, events: DataFrame, content: str = "Content") -> DataFrame:
    """Add ``ParameterList``: what the content holds in the gaps of its template.

    The pattern is built once per template, not once per line.
    """
    template = F.col("EventTemplate")
    patterns = events.select(
        "log_id",
        "EventId",
        T.parameter_pattern(template).alias("_pattern"),
        T.wildcard_count(template).alias("_gaps"),
    )
    joined = lookup_join(structured, patterns, ["log_id", "EventId"])
    found = T.parameters(F.col(content), F.col("_pattern"), F.col("_gaps"))
    return joined.withColumn("ParameterList", found).drop("_pattern", "_gaps")


def group_templates(templated: DataFrame, keys: list[str]) -> DataFrame:
    """Merge all templates of a group position by position: differing positions become gaps.

    Groups must hold templates of one length.  Positions are aggregated as rows, so a group
    of any size is combined before the shuffle.
    """
    distinct = templated.groupBy(*keys, "template").agg(F.count("*").alias("_lines"))
    positions = distinct.select(
        *keys, "_lines", F.posexplode(F.split("template", " ")).alias("_place", "_token")
    )
    merged = positions.groupBy(*keys, "_place").agg(
        F.min("_token").alias("_low"), F.max("_token").alias("_high"), F.sum("_lines").alias("_lines")
    )
    token = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit(WILDCARD))
    return merged.groupBy(*keys).agg(
        F.concat_ws(
            " ",
            F.transform(
                F.array_sort(F.collect_list(F.struct("_place", token.alias("_token")))),
                lambda p: p["_token"],
            ),
        ).alias("merged_template"),
        F.max("_lines").alias("n_lines"),
    )


def match_catalogue(lines: DataFrame, events: DataFrame, st: float) -> DataFrame:
    """Match lines to an existing catalogue by token similarity.

    ``lines`` has ``(log_id, line_no, template, n_tokens)``; ``events`` is a catalogue.  Adds
    ``EventId``, ``EventTemplate`` and ``similarity``, null where no event reaches ``st``.
    The best event has the highest similarity, then the most wildcards, then the lowest
    number.

    Each distinct text is compared once, whatever the number of lines that carry it.  The
    events of one length are held in lists of at most ``LIST_EVENTS``; a text gives one row
    per list, its best event there, so pairs are never written out.
    """
    number = F.substring("EventId", 6, 18).cast("bigint")
    lists = (
        events.withColumn("n_tokens", T.token_count(F.col("EventTemplate")))
        .groupBy("log_id", "n_tokens", F.floor(number / LIST_EVENTS).alias("_list"))
        .agg(
            F.collect_list(
                F.struct(
                    (-number).alias("age"),
                    F.split("EventTemplate", " ").alias("tokens"),
                    (F.col("n_tokens") - T.literal_count(F.split("EventTemplate", " "))).alias("wildcards"),
                )
            ).alias("_events")
        )
        .drop("_list")
    )
    keys = ["log_id", "n_tokens", "template"]
    texts = lines.groupBy(*keys).agg(F.min("line_no").alias("_first")).withColumn("_own", F.split("template", " "))
    joined = lookup_join(texts, lists, ["log_id", "n_tokens"], "inner")
    scored = F.transform(
        F.col("_events"),
        lambda e: F.struct(T.matched_literals(e["tokens"], F.col("_own")).alias("hits"), e["wildcards"], e["age"]),
    )
    best = (
        joined.groupBy(*keys)
        .agg(F.max(F.array_max(scored)).alias("_best"))
        .filter(F.col("_best.hits") / F.col("n_tokens") >= F.lit(st))
        .select(
            *keys,
            F.concat(F.lit("Event"), (-F.col("_best.age")).cast("string")).alias("EventId"),
            (F.col("_best.hits") / F.col("n_tokens")).alias("similarity"),
        )
    )
    named = best.join(events.select("log_id", "EventId", "EventTemplate"), ["log_id", "EventId"])
    return lookup_join(lines, named, keys)
