"""Packing documents into sequences of bounded length by multiway differencing.

A document longer than a window is cut into full windows, which need no company, and a rest.
Rests are dealt by hash into batches of about ``BATCH_TOKENS`` tokens and at most about
``BATCH_RESTS`` rests, and each batch is partitioned by the Karmarkar-Karp method: every rest starts as a partial partition with one
used window; the two partial partitions with the largest imbalance are merged so that the
fullest windows of one meet the emptiest of the other, until one partition is left.  Its windows
are nearly equal, so with the least number of windows that the tokens allow there is little
padding.  Where the fullest window exceeds the capacity, the number of windows rises and the
batch is partitioned anew.

Texts are encoded once; only piece lengths and checksums are shuffled.  A batch is bounded, so
any number of documents is packed by as many tasks as there are batches.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import bpe
from logweave.llm.common import map_rows
from logweave.session import materialize

CAPACITY = 4096
END_OF_TEXT = 2
#: Tokens and rests that are partitioned together, about.
BATCH_TOKENS, BATCH_RESTS = 1 << 20, 1 << 14


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item, by multiway differencing."""
    items, empty = len(lengths), len(lengths)
    owner = np.zeros(items + 1 + max(0, items - 1) * windows, np.int64)
    heap = []
    for item, length in enumerate(lengths.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, empty)
        sums[-1], nodes[-1] = length, item
        heap.append((-length if windows > 1 else 0, item, sums, nodes))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, _, left, left_nodes = heapq.heappop(heap)
        _, _, right, right_nodes = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(sums, kind="stable")
        first = items + 1 + len(merges) * windows
        merges.append((first, left_nodes, right_nodes[::-1]))
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), first, sums, first + order))
    # From the last merge back: the parts of a merged window lie in that window.
    owner[heap[0][3]] = np.arange(windows)
    for first, left_nodes, right_nodes in reversed(merges):
        own = owner[first : first + windows]
        owner[left_nodes] = own
        owner[right_nodes] = own
    return owner[:items]


def partition(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each item; no window holds more than ``capacity``, and windows are nearly equal."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = difference(lengths, windows)
        if np.bincount(window, lengths, windows).max() <= capacity:
            return window
        windows += max(1, windows // 256)


def pack_batch(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("row", "ascending")])
    lengths = table.column("length").to_numpy().astype(np.int64)
    window = partition(lengths, capacity)
    order = np.argsort(window, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    ordered = window[order]
    starts = begins[np.searchsorted(ordered, ordered)]
    offset = np.empty(len(lengths), np.int64)
    offset[order] = begins - starts
    batch = table.column("batch").to_numpy().astype(np.int64)
    sequence = (batch << 32 | window) * 2 + 1
    keep = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return keep.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def encode_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """row, doc_id, doc_tokens and the checksums of the document's pieces of ``capacity`` ids."""
    path = path or bpe.vocabulary_path()
    end = struct.pack("<I", END_OF_TEXT)

    def work(texts, encoder):
        rows = []
        for ids in encoder.encode_batch(texts):
            ids += end
            size = 4 * capacity
            rows.append((len(ids) // 4, [zlib.crc32(ids[a : a + size]) for a in range(0, len(ids), size)]))
        return rows

    encoded = map_rows(documents, ["text"], work, "doc_tokens long, crcs array<long>",
                       keep=("doc_id",), setup=lambda: bpe.encoder(path))
    return materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack(
    documents: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A document is its ids and the end id; null and empty texts are the end id alone.  Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.  Repeated rows
    are packed each on its own, a null doc_id stays null, other columns are not read; an empty
    table gives no piece.
    """
    encoded = encode_pieces(documents, path, capacity)
    pieces = encoded.select("row", "doc_id", "doc_tokens", F.posexplode("crcs").alias("n", "ids_crc32")).select(
        "row",
        "doc_id",
        (F.col("n").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("doc_tokens") - F.col("n") * capacity).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
    )
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rests = pieces.filter(F.col("length") < capacity)
    rest = F.col("doc_tokens") % capacity
    tokens, count = encoded.agg(F.coalesce(F.sum(rest), F.lit(0)), F.count_if(rest > 0)).first()
    # Many short rests are bounded by their number: a merge costs a place per window.
    batches = max(1, -(-tokens // batch_tokens), -(-count // BATCH_RESTS))
    packed = (
        rests.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("long"))
        .groupBy("batch")
        .applyInArrow(
            lambda table: pack_batch(table, capacity),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
    return full.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(packed)
