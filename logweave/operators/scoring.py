"""Answers scored against expected texts: TF-IDF cosine and ROUGE-1 F1."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import strip

COSINE, ROUGE = "Cosine Similarity", "ROUGE-1 F1"

# Default stop words of the cosine score: common English function words.  Pass another list
# to ``score_answers`` to follow a particular vectorizer.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before
    being below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers herself him himself his how i if in into is it
    its itself just me more most my myself no nor not now of off on once only or other our ours
    ourselves out over own same she should so some such than that the their theirs them themselves
    then there these they this those through to too under until up very was we were what when
    where which while who whom why will with would you your yours yourself yourselves""".split()
)

# What stands between words; unigrams are parts of the runs between.
_NO_WORD = r"[^\p{L}\p{N}_]+"
_UNIGRAM = re.compile("[a-z0-9]+")


def answers_long(answers: DataFrame, ids: list[str], models: list[str] | None = None) -> DataFrame:
    """One row per answered question and model; missing answers are left out."""
    models = models or [c for c in answers.columns if c not in ids]
    return answers.unpivot(ids, models, "model", "answer").filter(F.col("answer").isNotNull())


def finished_sheets(answers: DataFrame) -> DataFrame:
    """Leave out sheets whose name marks them as in progress."""
    return answers.filter(~F.startswith("sheet", F.lit("---")))


def normalise(text: Column) -> Column:
    """Lower case with single blanks between sentences."""
    return F.lower(F.regexp_replace(strip(text), F.lit(r"([.!?])\s+"), F.lit("$1 ")))


def score_answers(
    pairs: DataFrame,
    ids: list[str],
    expected: str = "expected",
    answer: str = "answer",
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Add ``cosine`` and ``rouge1`` to the id columns, one row per pair.

    Both scores need word counts of the two texts only.  The texts are shuffled once, by the
    ids of their pair, and come in that order to a task, which holds the counts of one pair at
    a time: no word becomes a row.  Rows with the same ids are one pair, whose counts are
    added up.  A pair without words scores 0.
    """
    ids, stopped = list(ids), frozenset(stop_words)
    # An answer that repeats the expected text is not sent again.
    same = F.col(answer).eqNullSafe(F.col(expected))
    sorted_pairs = (
        pairs.select(
            *ids, F.col(expected).alias("_expected"), F.when(~same, F.col(answer)).alias("_answer"), same.alias("_same")
        )
        .repartition(*ids)
        .sortWithinPartitions(*ids)
    )
    # Blanks do not change which words there are, so the texts need not be normalised for this.
    runs = lambda side: F.regexp_replace(F.lower(side), F.lit(_NO_WORD), F.lit(" "))
    sent = sorted_pairs.select(
        *ids, "_same", runs("_expected").alias("_expected"), F.when(~F.col("_same"), runs("_answer")).alias("_answer")
    )
    schema = pairs.select(*ids).schema.add("cosine", "double").add("rouge1", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, known = None, None, (None, None)
        for batch in batches:
            found: list[tuple] = []
            names = [batch.column(place).to_pylist() for place in range(len(ids))]
            same, expected_runs, answer_runs = [batch.column(place) for place in range(len(ids), batch.num_columns)]
            for row in range(batch.num_rows):
                text = expected_runs[row].as_py() or ""
                # The answers to one question follow each other.
                if known[0] != text:
                    known = text, _Counts.of(text, stopped)
                pair = known[1], known[1] if same[row].as_py() else _Counts.of(answer_runs[row].as_py() or "", stopped)
                own = tuple(column[row] for column in names)
                if sides is not None and key == own:
                    sides = tuple(one + other for one, other in zip(sides, pair))
                    continue
                if sides is not None:
                    found.append((*key, *_pair_scores(*sides)))
                key, sides = own, pair
            yield _scored(found, batch.schema, len(ids))
        if sides is not None:
            yield _scored([(*key, *_pair_scores(*sides))], batch.schema, len(ids))

    return sent.mapInArrow(run, schema)


class _Counts:
    """Counts of a text's words of two or more signs without stop words, and of the unigrams that lie in its runs."""

    def __init__(self, words: Counter, grams: Counter):
        self.words, self.grams = words, grams
        self.squares = sum(n * n for n in words.values())
        self.n_grams = grams.total()

    @classmethod
    def of(cls, runs: str, stopped: frozenset[str]) -> _Counts:
        words, grams = Counter(runs.split()), Counter()
        if runs.isascii() and "_" not in runs:
            grams.update(words)
        else:
            for run, n in words.items():
                for gram in _UNIGRAM.findall(run):
                    grams[gram] += n
        for word in [word for word in words if len(word) < 2 or word in stopped]:
            del words[word]
        return cls(words, grams)

    def __add__(self, other: _Counts) -> _Counts:
        return _Counts(self.words + other.words, self.grams + other.grams)


def _pair_scores(e: _Counts, a: _Counts) -> tuple[float, float]:
    if e is a:
        return float(e.squares > 0), float(e.n_grams > 0)
    shared = [(e.words[word], a.words[word]) for word in e.words.keys() & a.words.keys()]
    # Smoothed inverse document frequency over the two texts of the pair: 1 for shared words.
    idf = 1 + math.log(1.5)
    shared_e, shared_a = sum(n * n for n, _ in shared), sum(n * n for _, n in shared)
    e2 = shared_e + (e.squares - shared_e) * idf * idf
    a2 = shared_a + (a.squares - shared_a) * idf * idf
    cosine = sum(n * m for n, m in shared) / math.sqrt(e2 * a2) if e2 and a2 else 0.0
    overlap = sum(min(e.grams[gram], a.grams[gram]) for gram in e.grams.keys() & a.grams.keys())
    # 2PR / (P + R) with P = overlap / n_a and R = overlap / n_e.
    return cosine, 2 * overlap / (e.n_grams + a.n_grams) if overlap else 0.0


def _scored(rows: list[tuple], sent: pa.Schema, n_ids: int) -> pa.RecordBatch:
    kinds = [sent.field(place) for place in range(n_ids)] + [pa.field(name, pa.float64()) for name in ("cosine", "rouge1")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[place] for row in rows], field.type) for place, field in enumerate(kinds)], [f.name for f in kinds]
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    """``(sheet, model, category)`` with the mean of each score."""
    return scores.groupBy("sheet", "model", "category").agg(
        F.avg("cosine").alias(COSINE), F.avg("rouge1").alias(ROUGE)
    )


def melt_metrics(means: DataFrame) -> DataFrame:
    """``(sheet, model, category, metric, value)``."""
    return means.unpivot(["sheet", "model", "category"], [COSINE, ROUGE], "metric", "value")
