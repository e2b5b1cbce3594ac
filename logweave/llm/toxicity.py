"""Toxicity: a sparse linear classifier that does not react to which group a sentence mentions.

Features are the distinct words of a text and the beginnings of its words.  The candidates that
go with the label most clearly are counted by Spark over the labelled sample; a logistic model
with an L1 penalty is then fitted to them.  Its counterfactual term takes labelled sentences,
swaps the identity terms in them for others (a sentence without one gets a neutral mention) and
penalises the square of the change of the logit, so that weights of identity terms, and of words
that merely come with them, are driven to zero.

The sample is bounded by ``SAMPLE_ROWS`` rows; whole texts are read everywhere.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Remembered, keep_rows, labelled_sample, map_rows, one_class, remainder

#: Labelled documents that the model is fitted to, at most.
SAMPLE_ROWS = 12_000
#: Features that enter the fit, at most: the clearest ones.
FEATURES = 4096
LEAST_DOCUMENTS = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
HELD_OUT = (3, 1)

TERM = re.compile(r"\w+")

#: Neutral names of groups, by kind; a term is swapped for another of its kind.
IDENTITY = [
    ["woman", "man", "girl", "boy", "nonbinary", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "musulman", "juif",
     "jude", "judío", "cristiano", "musulmán"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "indigenous", "immigrant", "refugee"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    ["german", "french", "spanish", "english", "american", "chinese", "indian", "mexican", "turkish", "polish"],
    ["deaf", "blind", "disabled", "autistic", "elderly", "young"],
]
KIND = {term: kind for kind, terms in enumerate(IDENTITY) for term in terms}


def features_of_word(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


def features(text: str | None) -> set[str]:
    """Distinct words (marked) and beginnings of words."""
    found: set[str] = set()
    for word in set(TERM.findall((text or "").lower())):
        found.update(features_of_word(word))
    return found


def swapped(text: str | None, turn: int) -> str:
    """The text with every identity term swapped for another of its kind, or with one added."""
    text, found = text or "", False

    def other(match: re.Match) -> str:
        nonlocal found
        word = match[0].lower()
        if word not in KIND:
            return match[0]
        found = True
        terms = IDENTITY[KIND[word]]
        return terms[(terms.index(word) + 1 + turn % (len(terms) - 1)) % len(terms)]

    changed = TERM.sub(other, text)
    if found:
        return changed
    terms = IDENTITY[turn % len(IDENTITY)]
    return f"{text} {terms[turn // len(IDENTITY) % len(terms)]}"


def candidates(sample: DataFrame, limit: int) -> list[str]:
    """The features that go with the label most clearly, at most ``limit`` of them."""

    def count(batches):
        for batch in batches:
            seen, hit = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"]):
                own = features(text)
                seen.update(own)
                if label:
                    hit.update(own)
            yield pd.DataFrame({"feature": list(seen), "n": list(seen.values()), "k": [hit[f] for f in seen]})

    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    rate = (totals.k or 0) / max(1, totals.n)
    counted = sample.select("text", "label").mapInPandas(count, "feature string, n long, k long")
    excess = (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 0.5)
    found = counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    chosen = (
        found.filter((F.col("n") >= LEAST_DOCUMENTS) & (excess > 2))
        .select("feature", excess.alias("excess"))
        .orderBy(F.desc("excess"), "feature")
        .limit(limit)
    )
    return [r.feature for r in chosen.collect()]


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.column = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.height, self.width = len(rows), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.height)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.width)


def fit(
    plain: list[np.ndarray],
    swaps: list[np.ndarray],
    labels: np.ndarray,
    width: int,
    invariance: float = 1.0,
    sparsity: float = 5e-5,
    rounds: int = 600,
) -> tuple[np.ndarray, float]:
    """Weights (none negative) and intercept: accelerated proximal gradient."""
    x, y = Rows(plain, width), Rows(swaps, width)
    n = max(1, len(labels))
    bias, weights = 0.0, np.zeros(width)
    old_bias, old_weights = bias, weights
    norm = np.sqrt(np.bincount(x.column, minlength=width) / n) + 0.02
    for turn in range(rounds):
        push = turn / (turn + 3)
        b, w = bias + push * (bias - old_bias), weights + push * (weights - old_weights)
        logit = x.times(w) + b
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels
        change = y.times(w) - x.times(w)
        slope = x.back(error) / n + 2 * invariance * (y.back(change) - x.back(change)) / n
        old_bias, old_weights = bias, weights
        # Steps scaled by how often a feature occurs; rare features may grow quickly.
        bias = b - 1.0 * error.mean()
        weights = np.maximum(0, w - 0.5 * (slope + sparsity) / norm)
    return weights, bias


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], float]:
    """Weight per feature, and the intercept.  Without labelled rows of both kinds nothing is toxic."""
    sample = labelled_sample(documents, labels, "toxic", HELD_OUT, sample_rows)
    names = candidates(sample, FEATURES)
    place = {f: n for n, f in enumerate(names)}

    def encode(texts, _):
        ids = lambda text: [place[f] for f in features(text) if f in place]
        return [(ids(text), ids(swapped(text, len(text or "")))) for text in texts]

    rows = map_rows(sample, ["text"], encode, "plain array<long>, swap array<long>", keep=("doc_id", "label"))
    found = rows.toPandas().sort_values("doc_id", kind="stable")
    target = found["label"].to_numpy(np.float64)
    if one_class(target, "toxic"):
        return {}, -20.0
    arrays = lambda column: [np.sort(np.asarray(v, np.int64)) for v in found[column]]
    weights, bias = fit(arrays("plain"), arrays("swap"), target, len(names))
    return {f: float(w) for f, w in zip(names, weights) if w > 1e-4}, float(bias)


class Scorer:
    """Scores whole texts; remembers which words carry weight."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = Remembered(lambda word: tuple(f for f in features_of_word(word) if f in weights))

    def __call__(self, text: str | None) -> float:
        found: set[str] = set()
        for word in set(TERM.findall((text or "").lower())):
            held = self.words[word]
            if held:
                found.update(held)
        logit = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, logit)))))


def score(documents: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text is empty.

    Repeated rows stay, a null doc_id stays null; other columns are not read.
    """
    scored = map_rows(
        documents, ["text"], lambda texts, scorer: [(scorer(t),) for t in texts], "score double",
        keep=("doc_id",), setup=lambda: Scorer(*model),
    )
    return scored.select(
        "doc_id",
        (remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns.  The model is fitted to ``documents``."""
    model = train(documents, labels)

    def passes():
        scorer = Scorer(*model)
        return lambda text: scorer(text) < THRESHOLD

    return keep_rows(documents, passes)
