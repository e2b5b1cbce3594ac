"""From raw lines to a structured log and its event catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.formats import LogFormat, get_format
from logweave.functions.text import strip
from logweave.operators.mining import attach_mined, mine_assignments, mined_catalogue
from logweave.operators.parsing import parse_lines, with_line_ids
from logweave.operators.templates import attach_events, catalogue, masked_lines, with_parameters
from logweave.session import materialize


@dataclass(frozen=True)
class AnalysedLog:
    structured: DataFrame
    catalogue: DataFrame


def keep_line(lines: DataFrame) -> DataFrame:
    """Parsing drops ``line``; this keeps a stripped copy as ``raw``."""
    return lines.withColumn("raw", strip(F.col("line")))


def analyse(
    lines: DataFrame,
    fmt: str | LogFormat,
    masks: tuple[str, ...] | None = None,
    mined: bool = True,
) -> AnalysedLog:
    """Parse, mask, find templates, number events and extract parameters.

    The parsed and masked lines are written once and read by every later step.  With
    ``mined=False`` the masked text itself is the template.
    """
    fmt = get_format(fmt)
    masked = materialize(
        masked_lines(parse_lines(keep_line(lines), fmt), fmt.masks if masks is None else masks), "masked"
    )
    numbered = with_line_ids(masked)
    if mined:
        assignments = materialize(mine_assignments(masked, fmt.st, fmt.depth), "assignments")
        templated, events = attach_mined(numbered, assignments), mined_catalogue(assignments)
    else:
        templated, events = numbered, catalogue(masked)
    events = materialize(events, "catalogue")
    structured = with_parameters(attach_events(templated, events), events)
    ordered = ["log_id", "line_no", "LineId", *fmt.headers, "EventId", "EventTemplate", "ParameterList"]
    return AnalysedLog(structured.select(*ordered, F.col("raw").alias("line")), events)
