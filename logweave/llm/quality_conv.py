"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Learned filters of
``WIDTH`` bytes slide over the bytes; each filter keeps its highest response in a chunk
(max-pooling); a weighted sum of these gives the chunk's logit, and the mean over the chunks
gives the text's probability.

A filter is a table of a weight per place and byte value, so a response is a sum of table
rows; for scoring, places are joined in pairs, and two bytes are looked up at once.  Training
runs on a bounded sample of labelled rows, with gradients that flow to the highest responses
only.  Long texts are worked through in pieces of bounded size, with the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import bounded_bytes, labelled_sample, map_rows, one_class, remainder

FILTERS = 16
WIDTH = 5
#: Pooling first takes the highest response of each block of bytes, then of each chunk of blocks.
BLOCK = 64
CHUNK_BLOCKS = 8
STEP_BLOCKS = 7
#: Blocks worked through at a time.
PIECE_BLOCKS = 4096

#: Labelled documents that the network is fitted to, at most.
SAMPLE_ROWS = 4_000
#: Bytes of their texts, at most about; rows are left out beyond that, texts are never cut.
SAMPLE_BYTES = 64 << 20
HELD_OUT = (5, 0)
THRESHOLD = 0.3


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, filled with zeros to whole blocks, and a filter's width more."""
    data = (text or "").encode("utf-8", "replace")
    blocks = max(1, -(-len(data) // BLOCK))
    out = np.zeros(blocks * BLOCK + WIDTH - 1, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def chunk_starts(blocks: int) -> np.ndarray:
    """First blocks of the chunks; the last chunk reaches the text's end."""
    return np.arange(0, max(1, blocks - CHUNK_BLOCKS + STEP_BLOCKS), STEP_BLOCKS)


class Network:
    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        self.tables = random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.pairs: list[np.ndarray] = []

    def __getstate__(self):
        return self.__dict__ | {"pairs": []}

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Response of every filter at every place that has ``WIDTH`` bytes."""
        if not self.pairs:
            t = self.tables
            self.pairs = [(t[n][:, None, :] + t[n + 1][None, :, :]).reshape(65536, FILTERS) for n in (0, 2)]
        places = len(data) - WIDTH + 1
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        found = self.pairs[0].take(two[:places], axis=0)
        found += self.pairs[1].take(two[2 : 2 + places], axis=0)
        found += self.tables[4].take(data[4 : 4 + places], axis=0)
        return found

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        blocks = (len(data) - WIDTH + 1) // BLOCK
        found = np.empty((blocks, FILTERS), np.float32)
        for at in range(0, blocks, PIECE_BLOCKS):
            end = min(blocks, at + PIECE_BLOCKS)
            piece = self.responses(data[at * BLOCK : end * BLOCK + WIDTH - 1])
            found[at:end] = piece.reshape(end - at, BLOCK, FILTERS).max(axis=1)
        return found

    def chunk_logits(self, maxima: np.ndarray) -> np.ndarray:
        starts = chunk_starts(len(maxima))
        windows = np.minimum(starts[:, None] + np.arange(CHUNK_BLOCKS), len(maxima) - 1)
        pooled = maxima[windows].max(axis=1)
        return np.maximum(pooled + self.shift, 0) @ self.out + self.bias

    def __call__(self, text: str | None) -> float:
        logit = float(self.chunk_logits(self.block_maxima(padded(text))).mean(dtype=np.float64))
        return 1 / (1 + np.exp(-max(-40.0, min(40.0, logit))))


class Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.turn = values, rate, 0
        self.mean = [np.zeros_like(v) for v in values]
        self.square = [np.zeros_like(v) for v in values]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.turn += 1
        for value, slope, mean, square in zip(self.values, slopes, self.mean, self.square):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            even = np.sqrt(square / (1 - 0.999**self.turn)) + 1e-8
            value -= self.rate * (mean / (1 - 0.9**self.turn)) / even


def slopes_of(network: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss of a batch of texts."""
    tables = np.zeros(WIDTH * 256 * FILTERS)
    shift, out, bias = np.zeros(FILTERS), np.zeros(FILTERS), 0.0
    lanes = np.arange(FILTERS)
    for data, label in zip(texts, labels):
        maxima = network.block_maxima(data)
        starts = chunk_starts(len(maxima))
        windows = np.minimum(starts[:, None] + np.arange(CHUNK_BLOCKS), len(maxima) - 1)
        inside = maxima[windows]
        best = inside.argmax(axis=1)
        pooled = np.take_along_axis(inside, best[:, None, :], axis=1)[:, 0] + network.shift
        active = np.maximum(pooled, 0)
        logit = float((active @ network.out + network.bias).mean())
        error = (1 / (1 + np.exp(-max(-40.0, min(40.0, logit)))) - label) / len(texts)
        out += error * active.mean(axis=0)
        bias += error
        flow = error / len(starts) * network.out * (pooled > 0)
        shift += flow.sum(axis=0)
        # The place of the highest response inside each block that won a chunk.
        block = np.take_along_axis(windows, best, axis=1)
        used, inverse = np.unique(block, return_inverse=True)
        bytes_of = data[(used[:, None] * BLOCK + np.arange(BLOCK + WIDTH - 1))]
        place = np.empty((len(used), FILTERS), np.int64)
        for at in range(0, len(used), 512):
            part = bytes_of[at : at + 512]
            found = sum(network.tables[n][part[:, n : n + BLOCK]] for n in range(WIDTH))
            place[at : at + 512] = found.argmax(axis=1)
        row = inverse.reshape(block.shape)
        spot = place[row, lanes]
        for n in range(WIDTH):
            value = bytes_of[row, spot + n].astype(np.int64)
            where = (n * 256 + value) * FILTERS + lanes
            tables += np.bincount(where.ravel(), flow.ravel(), len(tables))
    shape = network.tables.shape
    return [tables.reshape(shape).astype(np.float32) + 1e-5 * network.tables, shift.astype(np.float32),
            out.astype(np.float32) + 1e-5 * network.out, np.array([bias], np.float32)]


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 5):
    network, random = Network(), np.random.default_rng(seed)
    bias = np.zeros(1, np.float32)
    adam = Adam([network.tables, network.shift, network.out, bias], rate)
    for turn in range(rounds):
        adam.rate = rate * (1 - turn / (rounds + 1))
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            network.pairs = []
            adam.step(slopes_of(network, [padded(texts[n]) for n in own], labels[own]))
            network.bias = bias[0]
    network.pairs = []
    return network


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit to a bounded sample of labelled rows.  Without labelled rows of both kinds every text is good."""
    sample = labelled_sample(documents, labels, "quality", HELD_OUT, sample_rows)
    sample = bounded_bytes(sample, SAMPLE_BYTES)
    found = sample.select("doc_id", "text", "label").toPandas().sort_values("doc_id", kind="stable")
    target = found["label"].to_numpy(np.float64)
    if one_class(target, "quality"):
        network = Network()
        network.out[:], network.bias = 0, np.float32(5)
        return network
    return fit(found["text"].tolist(), target)


def score(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text is empty.

    Repeated rows stay, a null doc_id stays null; other columns are not read.
    """
    scored = map_rows(
        documents, ["text"], lambda texts, network: [(float(network(t)),) for t in texts], "score double",
        keep=("doc_id",), setup=lambda: network,
    )
    return scored.select(
        "doc_id",
        (remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
