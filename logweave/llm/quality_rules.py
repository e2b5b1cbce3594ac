"""Quality rules: base figures of a text, and a calibrated logistic model of hashed n-grams.

The base figures are exact counts over the whole text.  The model averages the weights of a
text's hashed words and word pairs, and of its hashed character triples and quadruples, fitted by adaptive gradient steps to a bounded
sample of labelled rows; a part of the sample is kept aside to turn its output into a
probability (a logistic curve of two parameters).  Whole texts are scored in Arrow batches, and
a text is kept if no base figure rules it out and its probability reaches ``THRESHOLD``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import WORD, Remembered, keep_rows, labelled_sample, map_rows, one_class

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Labelled documents that the model is fitted to, at most.
SAMPLE_ROWS = 5_000
#: Buckets for each kind of n-gram: words, word pairs, character triples, character quadruples.
BUCKETS = 1 << 16
KINDS = 4
#: One labelled document in so many calibrates.
CALIBRATION = 5
#: Probability of good quality from which a text is kept.
THRESHOLD = 0.3
#: No labelled rows are held out here: a division by one has no remainder one.
HELD_OUT = (1, 1)

MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def base_figures(text: str | None, words: list[str]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether they rule the text out."""
    text = text or ""
    n_words = len(words)
    word_chars = sum(map(len, words))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        reach = 0
        for at, window in enumerate(windows):
            if window in often:
                n_repeat += at + 3 - max(reach, at)
                reach = at + 3
    failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED_PERCENT * n_words
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed


class Hasher:
    """Hashed n-grams of a text: buckets of its words, word pairs, character triples and quadruples."""

    def __init__(self):
        self.known = Remembered(lambda word: zlib.crc32(word.lower().encode("utf-8", "replace")))

    @staticmethod
    def buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (hashes & np.uint32(BUCKETS - 1)).astype(np.int64) + kind * BUCKETS

    def grams(self, text: str | None, words: list[str]) -> list[np.ndarray]:
        """Buckets of each kind of n-gram, in order."""
        word = np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))
        pairs = word[:-1] * MIX[0] ^ word[1:] * MIX[1]
        letters = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        mixed = [letters * factor for factor in MIX]
        triples = mixed[0][:-2] ^ mixed[1][1:-1] ^ mixed[2][2:]
        fours = triples[:-1] ^ mixed[3][3:] if len(letters) > 3 else triples[:0]
        shift = np.uint32(13)
        return [self.buckets(g, kind) for kind, g in enumerate((word, pairs >> shift, triples >> shift, fours >> shift))]

    def features(self, text: str | None, words: list[str]) -> bytes:
        """Distinct buckets and how often each occurs, in two bytes each, after their numbers by kind."""
        places, counts = [], []
        for kind, found in enumerate(self.grams(text, words)):
            place, count = np.unique(found - kind * BUCKETS, return_counts=True)
            places.append(place.astype("<u2"))
            counts.append(np.minimum(count, 65_535).astype("<u2"))
        sizes = np.array([len(place) for place in places], "<u4")
        return b"".join(part.tobytes() for part in (sizes, *places, *counts))


def shares(packed: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of packed features with their shares: those of each kind sum up to one."""
    sizes = np.frombuffer(packed, "<u4", KINDS)
    both = np.frombuffer(packed, "<u2", offset=4 * KINDS)
    kind = np.repeat(np.arange(KINDS), sizes)
    count = both[len(kind) :].astype(np.float64)
    return both[: len(kind)] + kind * BUCKETS, count / np.bincount(kind, count, KINDS)[kind]


def fit(rows: Sequence[bytes], labels: np.ndarray, rounds: int = 12, seed: int = 7):
    """Weights and intercept by adaptive gradient steps over batches of rows in a fixed random order."""
    random = np.random.default_rng(seed)
    weights, held = np.zeros(KINDS * BUCKETS), np.full(KINDS * BUCKETS, 1e-6)
    bias, batch = 0.0, 64
    for _ in range(rounds):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            parts = [shares(rows[n]) for n in own]
            place, share = (np.concatenate(part) for part in zip(*parts))
            row = np.repeat(np.arange(len(own)), [len(part[0]) for part in parts])
            logit = bias + np.bincount(row, weights[place] * share, len(own))
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[own]) / len(own)
            bias -= 0.5 * error.sum()
            touched, inverse = np.unique(place, return_inverse=True)
            slope = np.bincount(inverse, share * error[row]) + 1e-7 * weights[touched]
            held[touched] += slope * slope
            weights[touched] -= 0.5 * slope / np.sqrt(held[touched])
    return weights, bias


def fit_and_calibrate(keys: list, rows: list[bytes], target: np.ndarray) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Weights, intercept and calibration curve; a part of the rows, chosen by key, only calibrates."""
    aside = np.array([zlib.crc32(str(key).encode()) // 7 % CALIBRATION == 0 for key in keys])
    if not 0 < target[aside].sum() < aside.sum() or not 0 < target[~aside].sum() < (~aside).sum():
        aside = np.zeros(len(target), bool)
    weights, bias = fit([r for r, a in zip(rows, aside) if not a], target[~aside])
    checked = aside if aside.any() else np.ones(len(target), bool)
    logits = [bias + float((weights[place] * share).sum()) for place, share in (shares(r) for r, c in zip(rows, checked) if c)]
    return weights, bias, calibrate(np.array(logits), target[checked])


def calibrate(logits: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels best (Newton steps, smoothed targets)."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([logits, np.ones_like(logits)], axis=1)
    loss = lambda v: np.logaddexp(0, design @ v).sum() - target @ (design @ v) + 1e-3 * (v @ v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        slope = design.T @ (p - target) + 2e-3 * at
        curve = (design * (p * (1 - p))[:, None]).T @ design + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class Model:
    """Probability that a text is of good quality."""

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve
        self.hasher: Hasher | None = None

    def __getstate__(self):
        return self.__dict__ | {"hasher": None}

    def logit(self, text: str | None, words: list[str]) -> float:
        self.hasher = self.hasher or Hasher()
        total = self.bias
        for found in self.hasher.grams(text, words):
            if len(found):
                total += float(self.weights[found].mean(dtype=np.float64))
        return total

    def __call__(self, text: str | None, words: list[str]) -> float:
        value = self.curve[0] * self.logit(text, words) + self.curve[1]
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, value)))))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to a bounded sample of labelled rows.  Without rows of both kinds every text is good."""
    sample = labelled_sample(documents, labels, "quality", HELD_OUT, sample_rows)

    marks = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if one_class([1] * marks.get(1, 0) + [0] * marks.get(0, 0), "quality"):
        return Model(np.zeros(KINDS * BUCKETS), 5.0, (1.0, 0.0))
    encode = lambda texts, hasher: [(hasher.features(text, WORD.findall(text or "")),) for text in texts]
    found = map_rows(sample, ["text"], encode, "features binary", keep=("doc_id", "label"), setup=Hasher)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "features", "label")])]
        rows.sort(key=lambda row: row[:2])
        weights, bias, curve = fit_and_calibrate([r[0] for r in rows], [r[1] for r in rows], np.array([float(r[2]) for r in rows]))
        values = [[weights.astype("<f4").tobytes()], [bias], [curve[0]], [curve[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["weights", "bias", "slope", "shift"])

    # The sample is bounded; one task fits it, and only the weights come to the driver.
    made = found.repartition(1).mapInArrow(fitted, "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(made.weights, "<f4"), made.bias, (made.slope, made.shift))


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double"
)


def judge_text(text: str | None, model: Model) -> tuple:
    words = WORD.findall(text or "")
    return (*base_figures(text, words), model(text, words))


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """The base figures, base_failed, probability and kept of every row, with its doc_id.

    A null text has no words.  Repeated rows stay, a null doc_id stays null; other columns are
    not read.
    """
    judged = map_rows(
        documents, ["text"], lambda texts, model: [judge_text(t, model) for t in texts], SCHEMA,
        keep=("doc_id",), setup=lambda: model,
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= THRESHOLD))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns.  The model is fitted to ``documents``."""
    model = train(documents, labels)

    def passes(text: str | None) -> bool:
        judged = judge_text(text, model)
        return not judged[5] and judged[6] >= THRESHOLD

    return keep_rows(documents, lambda: passes)
