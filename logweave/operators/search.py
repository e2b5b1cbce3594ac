"""Keyword and event search over log lines, capped results, event mentions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.text import contains_any, event_mentions, strip
from logweave.operators.gram_index import GramIndex
from logweave.session import lookup_join, materialize
from logweave.sources.lines import contiguous_ids

# Result lines shown per keyword search and per event search.
KEYWORD_CAP = 200
EVENT_CAP = 150

# Distinct words tested one by one on each line; more words go through the gram join.
INLINE_WORDS = 64
_GRAM = 3
_SET_MARK = "\u0001"


def keyword_search(lines: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Lines that hold any of the keywords, ignoring case; an empty keyword matches all."""
    return lines.filter(contains_any(F.col("line"), keywords)).select(
        "log_id", "line_no", strip(F.col("line")).alias("line")
    )


def cap_matches(matches: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """First ``cap`` lines per group, with the true total and a ``trimmed`` flag.

    Totals are partial counts, and the rank filter is applied before the shuffle too, so a
    group with any number of matches sends at most ``cap`` lines per task.  A total equal to
    the cap counts as trimmed.
    """
    totals = matches.groupBy(*keys).agg(F.count("*").alias("n_matched"))
    order = W.partitionBy(*keys).orderBy("line_no")
    return (
        matches.withColumn("place", F.row_number().over(order).cast("bigint"))
        .filter(F.col("place") <= cap)
        .join(totals, keys)
        .withColumn("trimmed", F.col("n_matched") >= cap)
    )


def with_set_key(questions: DataFrame) -> DataFrame:
    """Add ``set_key``: equal for questions with the same keywords, whatever case or order."""
    lowered = F.array_sort(F.array_distinct(F.transform("keywords", F.lower)))
    return questions.withColumn("set_key", F.array_join(lowered, _SET_MARK))


def line_words(lines: DataFrame, words: DataFrame, inline_words: int = INLINE_WORDS) -> DataFrame:
    """``(log_id, line_no, words)``: which of ``words(word)`` each line holds; others left out.

    ``words`` are distinct and in lower case.  An empty word is in every line.
    """
    words = materialize(words.select("word"), "words")
    if words.limit(inline_words + 1).count() <= inline_words:
        return _words_inline(lines, words)
    return _words_by_gram(lines, words)


def _words_inline(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Few words: test each of them on each line."""
    known = F.array(*[F.lit(row.word) for row in words.collect()])  # at most ``inline_words``
    held = F.transform(
        F.array(F.lower("line")),
        lambda text: F.filter(known.cast("array<string>"), lambda word: F.contains(text, word)),
    )[0]
    return lines.select("log_id", "line_no", held.alias("words")).filter(F.size("words") > 0)


def _words_by_gram(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Many words: meet lines and words on one gram of the word.

    A line that holds a word holds each gram of it, so any gram will do; the one that fewest
    other words share keeps the candidates few.  The substring test afterwards keeps the true
    ones.
    """
    word = F.col("word")
    width = F.least(F.length(word), F.lit(_GRAM))
    grams = words.select(
        "word",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length(word) - width + 1), lambda i: F.substring(word, i, width)
            )
        ).alias("gram"),
    )
    shared = grams.groupBy("gram").agg(F.count_distinct("word").alias("_words"))
    chosen = (
        grams.join(shared, "gram")
        .groupBy("word")
        .agg(F.min(F.struct("_words", "gram"))["gram"].alias("gram"))
    )
    chosen = materialize(chosen, "grams")
    keyed = chosen.groupBy("gram").agg(F.collect_list("word").alias("_candidates"))
    widths = [row.w for row in chosen.select(F.length("gram").alias("w")).distinct().collect()]  # at most 4
    text = F.lower("line")

    def all_grams(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_text") - (width - 1), F.lit(1)))
        return F.transform(starts, lambda start: F.substring("_text", start, F.lit(width)))

    pieces = F.array_distinct(F.flatten(F.array(*map(all_grams, widths))))
    # The one-row generator keeps the lowered text from being computed again for every gram.
    lowered = lines.select("log_id", "line_no", F.explode(F.array(text)).alias("_text"))
    rows = lowered.select("log_id", "line_no", "_text", F.explode(pieces).alias("gram"))
    met = lookup_join(rows, keyed, ["gram"], "inner")
    held = F.filter("_candidates", lambda w: F.contains(F.col("_text"), w))
    return (
        met.select("log_id", "line_no", F.explode(held).alias("word"))
        .groupBy("log_id", "line_no")
        .agg(F.collect_list("word").alias("words"))
    )


class KeywordSets:
    """Distinct keyword sets of a batch of questions, with the lines that hold their words.

    The words of a set are ordered by the number of lines that hold them.  A line belongs to
    the set through its first word in this order, so each line is counted once for a set, and
    the lines of the most frequent word need not be listed per set at all.
    """

    def __init__(
        self, lines: DataFrame, questions: DataFrame, inline_words: int = INLINE_WORDS, index: GramIndex | None = None
    ):
        """With an ``index`` of the same lines only the blocks that it names are read for the words."""
        self.lines = lines
        sets = materialize(
            with_set_key(questions)
            .filter(F.size("keywords") > 0)
            .select("set_key", F.explode("keywords").alias("word"))
            .select("set_key", F.lower("word").alias("word"))
            .distinct(),
            "keyword_sets",
        )
        words = materialize(sets.select("word").distinct(), "asked_words")
        self.held = materialize(index.line_words(words) if index else line_words(lines, words, inline_words), "line_words")
        self.totals = materialize(
            self.held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_lines")),
            "word_totals",
        )
        # (set_key, word, n_lines, earlier): the words of the set before this one.
        order = W.partitionBy("set_key").orderBy(F.desc("n_lines"), "word")
        self.members = materialize(
            sets.join(self.totals, "word").select(
                "set_key",
                "word",
                "n_lines",
                F.collect_list("word").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
            ),
            "set_members",
        )

    def _new_lines(self, roles: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """Lines that hold ``word`` and none of ``earlier``, for each distinct pair in ``roles``."""
        rows = (self.held if held is None else held).withColumn("word", F.explode("words"))
        paired = roles.groupBy("word").agg(F.collect_set("earlier").alias("_roles"))
        met = lookup_join(rows, paired, ["word"], "inner")
        return met.withColumn("earlier", F.explode("_roles")).drop("_roles").filter(~F.arrays_overlap("words", "earlier"))

    def matches(self) -> DataFrame:
        """Every matching line of every set: ``(set_key, log_id, line_no, line)``.

        A line gets its text once, before it is handed to the sets that it belongs to.
        """
        text = self.lines.select("log_id", "line_no", strip(F.col("line")).alias("line"))
        members = self.members.select("word", "earlier", "set_key")
        new = self._new_lines(members.select("word", "earlier").distinct(), self.held.join(text, ["log_id", "line_no"]))
        return lookup_join(new, members, ["word", "earlier"], "inner").select("set_key", "log_id", "line_no", "line")

    def capped(self, cap: int = KEYWORD_CAP) -> DataFrame:
        """``(set_key, log_id, place, line_no, line, n_matched, trimmed)``: first lines and true total per log.

        The first lines of a set are among the first lines of its words, and words with many
        lines are listed once for all sets.
        """
        later = self.members.filter(F.size("earlier") > 0)
        extra = self._new_lines(later.select("word", "earlier").distinct()).groupBy("log_id", "word", "earlier").agg(
            F.count("*").alias("n_new")
        )
        in_log = self.held.select("log_id", F.explode("words").alias("word")).groupBy("log_id", "word").agg(
            F.count("*").alias("n_log")
        )
        n_new = F.when(F.size("earlier") == 0, F.col("n_log")).otherwise(F.coalesce("n_new", F.lit(0)))
        totals = (
            self.members.join(in_log, "word")
            .join(extra, ["log_id", "word", "earlier"], "left")
            .groupBy("set_key", "log_id")
            .agg(F.sum(n_new).alias("n_matched"))
        )
        by_line = W.partitionBy("log_id", "word").orderBy("line_no")
        firsts = materialize(
            self.held.select("log_id", "line_no", F.explode("words").alias("word"))
            .withColumn("_place", F.row_number().over(by_line))
            .filter(F.col("_place") <= cap)
            .select("log_id", "word", "line_no"),
            "first_lines",
        )
        wanted = firsts.select("log_id", "line_no").distinct()
        text = lookup_join(
            self.lines.select("log_id", "line_no", strip(F.col("line")).alias("line")), wanted, ["log_id", "line_no"], "inner"
        )
        in_set = W.partitionBy("set_key", "log_id").orderBy("line_no")
        return (
            self.members.join(firsts, "word")
            .select("set_key", "log_id", "line_no")
            .distinct()
            .withColumn("place", F.row_number().over(in_set).cast("bigint"))
            .filter(F.col("place") <= cap)
            .join(totals, ["set_key", "log_id"])
            .join(text, ["log_id", "line_no"])
            .withColumn("trimmed", F.col("n_matched") >= cap)
        )


def event_search(structured: DataFrame, events: Iterable[str]) -> DataFrame:
    """Lines of the given events, found by their own line number."""
    return structured.filter(F.col("EventId").isin(list(events)))


def event_lookup(catalogue: DataFrame, events: Iterable[str]) -> DataFrame:
    return catalogue.filter(F.col("EventId").isin(list(events)))


def event_hits(structured: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of all events named in ``wanted(EventId)``, each line once."""
    return lookup_join(structured, wanted.select("EventId").distinct(), ["EventId"], "left_semi")


def event_lines(structured: DataFrame) -> DataFrame:
    """Lines grouped per event: ``(log_id, EventId, place, line_no, line)``, one row per line.

    ``place`` counts 1, 2, 3 … inside the event.  Rows instead of one list per event, because
    an event may hold most lines of a log; see ``event_pages`` for lists of bounded length.
    """
    keyed = structured.select(
        "log_id", "EventId", "line_no", "line", F.concat_ws(":", "log_id", "EventId").alias("_event")
    )
    return contiguous_ids(keyed, "_event", "line_no", "place").select(
        "log_id", "EventId", "place", "line_no", "line"
    )


def event_pages(structured: DataFrame, page_lines: int = 1000) -> DataFrame:
    """Lists of at most ``page_lines`` lines: ``(log_id, EventId, page, lines)``."""
    page = F.floor((F.col("place") - 1) / page_lines).alias("page")
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return (
        event_lines(structured)
        .groupBy("log_id", "EventId", page)
        .agg(F.transform(ordered, lambda e: e["line"]).alias("lines"))
    )


def mentions(answers: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct event name in a text, in order of first mention."""
    kept = [c for c in answers.columns if c != text]
    return answers.select(*kept, F.posexplode(event_mentions(F.col(text))).alias("place", "EventId"))


def mention_lines(answers: DataFrame, structured: DataFrame, text: str = "text") -> DataFrame:
    """Lines of every mentioned event, each event once, with the number of texts naming it."""
    named = mentions(answers, text).groupBy("EventId").agg(F.count("*").alias("n_mentions"))
    return lookup_join(structured, named, ["EventId"], "inner")
