"""Questions paired with their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.sources.lines import contiguous_ids


def exchanges(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, user_input, response)`` per user turn; null while unanswered.

    The answer is the next message of the conversation if the assistant wrote it.  Turns are
    numbered without gaps and then met by an equi-join on conversation and number, so one
    conversation with most of the messages is spread over all tasks.
    """
    numbered = contiguous_ids(turns, "conv_id", "turn", "_place", bucket_rows=1 << 12)
    asked = numbered.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_input"), (F.col("_place") + 1).alias("_place")
    )
    replied = numbered.filter(F.col("role") == "assistant").select(
        "conv_id", "_place", F.col("text").alias("response")
    )
    return asked.join(replied, ["conv_id", "_place"], "left").drop("_place")


def exchange_metrics(answered: DataFrame, elapsed: str = "elapsed") -> DataFrame:
    """Add the response time as text and the written characters per second."""
    return answered.withColumn(
        "response_time", F.concat(F.format_string("%.2f", F.col(elapsed)), F.lit(" seconds"))
    ).withColumn("chars_per_second", F.length("response") / F.col(elapsed))


def exchange_note(
    route: Column, keywords: Column, events: Column, elapsed: Column, response: Column
) -> Column:
    """What is saved next to an answer: route, search terms if any, time taken and speed."""

    def listed(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, ", ")))

    return F.concat_ws(
        " | ",
        F.concat(F.lit("Route: "), F.initcap(route)),
        listed("Keywords", keywords),
        listed("Events", events),
        F.format_string("Time Taken: %.2f s", elapsed),
        F.format_string("Tokens/Second: %.2f", F.length(response) / elapsed),
    )
