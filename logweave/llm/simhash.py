"""Near-duplicates by SimHash: tiled exact comparison of all fingerprints.

Fingerprints that are equal are one vertex.  The distinct ones are sorted into tiles by the
population counts of their two 32-bit halves.  Two fingerprints differ in at least as many bits
as their counts differ, half by half, so a tile meets only the tiles whose counts are within
the radius; all other tile pairs are skipped.  Inside a task, a large tile is cut again by the
counts of its four 16-bit words, and the same bound skips parts of it.  What is left is compared
in full by exclusive-or and bit counts on numpy blocks that fit the processor's cache.

A block pair gives back only a spanning forest of its links: no component is lost, and a
thousand near copies cost a thousand rows, not a million.  Components are then found by
contraction: every vertex hooks to its smallest neighbour until no edge is left.

The comparison is exact, so its work grows with the square of the number of distinct
fingerprints, times the part of tile pairs that are not skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import WORD, attach_groups, chosen_documents, map_rows, text_digest
from logweave.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a block of a tile, at most.
BLOCK = 1 << 16
#: Block pairs that are sent to Python at a time.
PAIRS_SENT = 32
#: Pairs compared at a time.
PANEL = 1 << 17
UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's 4-word shingles; zero without a word."""
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    # One encoding of the whole text; a shingle is a slice of it.
    joined = " ".join(words).encode("utf-8", "replace")
    sizes = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "replace")) for w in words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) <= SHINGLE:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and fingerprint as a signed 64-bit number, one row per row."""

    def work(texts, _):
        return [(int(np.uint64(fingerprint(text)).astype(np.int64)),) for text in texts]

    return map_rows(documents, ["text"], work, "fingerprint long", keep=keep)


class Forest:
    """Union of places by their smallest member."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, place: int) -> int:
        parent = self.parent
        while parent[place] != place:
            parent[place] = parent[parent[place]]
            place = parent[place]
        return place

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        # Pairs that already have the same parent add nothing.
        new = self.parent[left] != self.parent[right]
        for a, b in zip(left[new].tolist(), right[new].tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


def word_counts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words."""
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int16)


def parts_of(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of a block, cut by the counts of the words, with the counts."""
    counts = word_counts(values)
    if len(values) < 1024:
        return [(np.arange(len(values)), None)]
    key = counts[:, 0].astype(np.int64) * 17 + counts[:, 2]
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(places, counts[places[0]]) for places in np.split(order, cuts)]


def linked(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """Spanning forest of the links between two blocks: rows of two fingerprints."""
    forest = Forest(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)
    right_parts = parts_of(right)
    for n, (a, a_counts) in enumerate(parts_of(left)):
        for b, b_counts in right_parts[n:] if same else right_parts:
            if a_counts is not None and b_counts is not None and np.abs(a_counts - b_counts).sum() > radius:
                continue
            x, y = left[a], right[b]
            step = max(1, PANEL // len(y))
            for at in range(0, len(x), step):
                near = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius
                i, j = np.nonzero(near)
                if len(i):
                    forest.join(a[i + at], b[j] + shift)
    both = left if same else np.concatenate([left, right])
    child = np.flatnonzero(forest.parent != np.arange(len(both)))
    return np.stack([both[child], both[forest.parent[child]]], axis=1)


def compare_blocks(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [np.empty((0, 2), np.uint64)]
        for left, right, same in zip(batch["left"], batch["right"], batch["same"]):
            found.append(linked(np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8"), same, radius))
        links = np.concatenate(found).astype(np.int64)
        yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def blocks(vertices: DataFrame) -> DataFrame:
    """Tiles (counts of the halves), each cut into blocks of bounded size: low, high, part, packed."""
    low = F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fingerprint", 32))
    rows = vertices.select("fingerprint", low.cast("int").alias("low"), high.cast("int").alias("high"))
    # 33 times 33 tiles at most, whatever the input.
    cuts = rows.groupBy("low", "high").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    part = F.pmod(F.xxhash64("fingerprint", F.lit("block")), F.col("cuts"))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("fingerprint")), little_endian_hex), ""))
    return (
        rows.join(F.broadcast(cuts), ["low", "high"])
        .groupBy("low", "high", part.alias("part"))
        .agg(packed.alias("packed"))
    )


def little_endian_hex(value):
    plain = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(plain, 15 - 2 * n, 2) for n in range(8)])


def links(vertices: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links that connect all distinct fingerprints within the radius: columns a, b."""
    spark = vertices.sparkSession
    tiles = materialize(blocks(vertices), "simhash-tiles")
    steps = [
        (x, y)
        for x in range(-radius, radius + 1)
        for y in range(-radius, radius + 1)
        if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)
    ]
    offsets = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])
    left = tiles.withColumn("o", F.explode(offsets)).select(
        F.col("low").alias("l_low"),
        F.col("high").alias("l_high"),
        F.col("part").alias("l_part"),
        F.col("packed").alias("left"),
        (F.col("low") + F.col("o.x")).alias("low"),
        (F.col("high") + F.col("o.y")).alias("high"),
    )
    own = (F.col("l_low") == F.col("low")) & (F.col("l_high") == F.col("high"))
    pairs = (
        left.join(tiles.withColumnRenamed("packed", "right"), ["low", "high"])
        .filter(~own | (F.col("l_part") <= F.col("part")))
        .select("left", "right", (own & (F.col("l_part") == F.col("part"))).alias("same"))
    )
    # A pair holds up to a megabyte: few of them go to Python together.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PAIRS_SENT)
    try:
        found = pairs.repartition(F.xxhash64("left", "right")).mapInPandas(
            lambda batches: compare_blocks(batches, radius), "a long, b long"
        )
        return materialize(found.distinct(), "simhash-links")
    finally:
        spark.conf.set(setting, before)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of the edges ``a, b``, by contraction.

    In a round every root hooks to its smallest neighbour if that is smaller; chains of hooks
    are followed to their end, edges are renamed and those inside a component go.  A round at
    least halves the roots that still have edges.
    """
    edges = edges.filter("a <> b")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        hooks = materialize(hooks, "cc-hooks")
        while True:
            up = hooks.select(F.col("a").alias("b"), F.col("b").alias("top"))
            jumped = materialize(hooks.join(up, "b").select("a", F.col("top").alias("b"), (F.col("b") != F.col("top")).alias("moved")), "cc-jump")
            hooks = jumped.select("a", "b")
            if jumped.filter("moved").isEmpty():
                break
        left = hooks.select("a", F.col("b").alias("new_a"))
        right = hooks.select(F.col("a").alias("b"), F.col("b").alias("new_b"))
        edges = materialize(
            edges.join(left, "a").join(right, "b").filter("new_a <> new_b")
            .select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).distinct(),
            "cc-edges",
        )
        if names is None:
            names = hooks.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        else:
            step = hooks.select(F.col("a").alias("root"), F.col("b").alias("next"))
            names = materialize(
                names.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), "cc-names"
            )
    if names is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return names


def linked_rows(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (with doc_id and fingerprint) with component_id and root, the component's own mark."""
    rows = materialize(rows, "fingerprints")
    vertices = materialize(
        rows.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("group_size")), "vertices"
    )
    roots = components(links(vertices, radius))
    # One row per distinct fingerprint up to here; each is looked up once.
    named = vertices.join(roots.select(F.col("vertex").alias("fingerprint"), "root"), "fingerprint", "left").select(
        "fingerprint", "smallest", "group_size", F.coalesce("root", "fingerprint").alias("root")
    )
    # A component may hold many fingerprints: its result goes back to them like a group's.
    named = materialize(named.withColumnRenamed("group_size", "copies"), "vertex-roots")
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("group_size"))
    smallest = materialize(smallest, "component-minima")
    named = materialize(
        attach_groups(named, smallest, "root", named.count()).select(
            "fingerprint", "component_id", "root", F.col("copies").alias("group_size")
        ),
        "vertex-components",
    )
    return attach_groups(rows, named, "fingerprint", rows.count())


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links reach, itself included.  Null and wordless
    texts have the fingerprint zero and are linked like any other.  Repeated rows stay; a null
    doc_id counts only where a component has no other, and the component_id is null then.  Other
    columns are not read; an empty table gives an empty result.
    """
    return linked_rows(fingerprints(documents), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns."""
    marked = documents.select("doc_id", "text", text_digest().alias("digest"))
    rows = linked_rows(fingerprints(marked, ("doc_id", "digest")), radius)
    rows = rows.groupBy("root", F.col("doc_id").cast("long").alias("doc_id"), "digest").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "rows")).alias("first")
    return chosen_documents(documents, rows.groupBy("root").agg(first).select("first.*"))
