"""What each of a set of filters removes, keeps and repeats, for every order of the filters.

Four filters look at a text alone; the fifth asks whether a smaller doc_id has the same text.
That is answered by radix tries.  A task first puts its own rows into a compressed trie, whose
terminals hold the smallest id of their text: a row that meets a smaller id is a duplicate at
once, and one row per text goes on.  These are dealt by ranges of adaptive text prefixes, which
are as long as it takes that no prefix holds much text, so all copies of a text, and its
neighbours, meet in one task; texts that share a long beginning are told apart behind it.  Each
task inserts its full texts into a trie again and passes through it for the rest of the flags.

Every row is then one mask of failed filters.  Equal masks are counted per part, and all orders
are worked out from these counts, of which a part has at most 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import BATCH_BYTES, HOT_SHARE, slices
from logweave.session import lookup_join, materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that continue a code point in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))
DUPLICATE = 1 << FILTERS.index("E")

#: Text that one trie holds, about.
TRIE_BYTES = 16 << 20
#: Tasks that first share the copies of a text of which there is much.
SALTS = 64
#: Bytes of the shortest prefix, and how much longer the next one is.
PREFIX, LONGER = 16, 4
#: A null id counts as larger than every other one.
LAST = 1 << 63


class Node:
    __slots__ = ("edges", "held")

    def __init__(self):
        #: First byte of an edge's label: (label, node).
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        #: Smallest id of the text that ends here, and the rows that have it.
        self.held: tuple[int, list] | None = None


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` stand in ``text`` from ``at`` on, by halves."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed trie of whole texts; a text's terminal holds its smallest id."""

    def __init__(self):
        self.root, self.size = Node(), 0

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            if node.edges is None:
                node.edges = {}
            edge = node.edges.get(text[at])
            if edge is None:
                child = Node()
                node.edges[text[at]] = text[at:], child
                self.size += len(text) - at
                return child
            label, child = edge
            if text.startswith(label, at):
                at += len(label)
            else:
                same = shared(label, text, at)
                middle = Node()
                middle.edges = {label[same]: (label[same:], child)}
                node.edges[text[at]] = label[:same], middle
                child, at = middle, at + same
            node = child
        return node

    def insert(self, text: bytes, key: int, row) -> list:
        """Put a row under its text; returns the rows that are now known to have a smaller id beside them."""
        node = self.terminal(text)
        if node.held is None or key < node.held[0]:
            beaten = node.held[1] if node.held else []
            node.held = key, [row]
            self.size += 200
            return beaten
        if key > node.held[0]:
            return [row]
        node.held[1].append(row)
        return []

    def held(self) -> Iterator[tuple[bytes, list]]:
        """Texts in no order, with the rows of their smallest id."""
        stack = [(b"", b"", self.root)]
        while stack:
            before, label, node = stack.pop()
            text = before + label
            if node.held:
                yield text, node.held[1]
            stack += [(text, label, child) for label, child in (node.edges or {}).values()]


def failures(text: bytes) -> int:
    """Mask of the filters that a text fails by itself."""
    words = text.split()
    points = len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


_MASKS = "doc_id long, part string, mask int, text binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, part, mask, text or null)."""
    kinds = {"doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "text": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds.values())], list(kinds)
    )


class _Writer:
    """Collects rows into batches of bounded bytes."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += 64 + len(row[3] or b"")
        if self.bytes >= BATCH_BYTES:
            yield self.rest()

    def rest(self) -> pa.RecordBatch:
        made = _batch(self.rows)
        self.rows, self.bytes = [], 0
        return made


def _firsts(trie: Trie, out: _Writer, with_text: bool) -> Iterator[pa.RecordBatch]:
    """The rows that no smaller id was met for."""
    for text, rows in trie.held():
        for row in rows:
            yield from out.add((*row, text if with_text else None))


def _beaten(trie: Trie, out: _Writer, text: bytes, row: tuple) -> Iterator[pa.RecordBatch]:
    """Insert a row (doc_id, part, mask) and write the rows that it shows to be duplicates."""
    key = LAST if row[0] is None else row[0]
    for key, part, mask in trie.insert(text, key, row):
        yield from out.add((key, part, mask | DUPLICATE, None))


def own_masks(documents: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Masks of all rows; a row that may be the first of its text has the text as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Writer()
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                for key, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts):
                    text = text or b""
                    yield from _beaten(trie, out, text, (key, part or "", failures(text)))
                if trie.size > trie_bytes:
                    yield from _firsts(trie, out, True)
                    trie = Trie()
        yield from _firsts(trie, out, True)
        yield out.rest()

    columns = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")]
    return materialize(documents.select(*columns).mapInArrow(run, _MASKS), "filter-masks")


def adaptive_prefixes(texts: DataFrame, limit: int) -> DataFrame:
    """Add ``prefix``: the text's beginning, longer where a shorter one holds more than ``limit`` bytes of text.

    Prefixes that hold too much are lengthened until none does, or until they are whole texts; of
    them there are at most so many as the limit goes into all bytes.
    """
    length = PREFIX
    marked = texts.withColumn("prefix", F.substring("text", 1, length))
    while True:
        sums = marked.filter(F.octet_length("prefix") == length).groupBy("prefix").agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest")
        )
        heavy = materialize(
            sums.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("prefix", F.lit(True).alias("heavy")),
            "filter-prefixes",
        )
        if heavy.isEmpty():
            return marked
        length *= LONGER
        longer = F.when(F.col("heavy"), F.substring("text", 1, length)).otherwise(F.col("prefix"))
        marked = lookup_join(marked, heavy, ["prefix"], "left").withColumn("prefix", longer).drop("heavy")


def flag_in_tries(dealt: DataFrame, with_text: bool) -> DataFrame:
    """Flag the duplicates that meet in a task; rows that no smaller id was met for keep their text, if it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Writer()
        for whole in batches:
            for batch in slices(whole):
                for *row, text in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "part", "mask", "text")]):
                    yield from _beaten(trie, out, text, tuple(row))
        yield from _firsts(trie, out, with_text)
        yield out.rest()

    return dealt.select("doc_id", "part", "mask", "text").mapInArrow(run, _MASKS)


def trie_masks(firsts: DataFrame) -> DataFrame:
    """Masks of the rows that came with their texts, duplicates among them flagged.

    Prefixes that hold too much although they are whole texts belong to copies that many tasks
    have each found a first of.  Those are dealt by prefix and a part of the id before, so that no
    task gets all of them.
    """
    size = firsts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = max(1, min(TRIE_BYTES, size // HOT_SHARE))
    parts = max(firsts.sparkSession.sparkContext.defaultParallelism, -(-size // TRIE_BYTES))
    marked = adaptive_prefixes(firsts, limit)
    sums = marked.groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("bytes"))
    copies = materialize(sums.filter(F.col("bytes") > limit).select("prefix"), "filter-copies")
    if copies.isEmpty():
        return flag_in_tries(marked.repartitionByRange(parts, "prefix"), False)
    shared = lookup_join(marked, copies, ["prefix"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    shared = materialize(flag_in_tries(shared.repartitionByRange(parts, "prefix", "salt"), True), "filter-shared")
    rest = lookup_join(marked, copies, ["prefix"], "left_anti")
    left = shared.filter("text is not null").withColumn("prefix", F.col("text"))
    found = flag_in_tries(rest.unionByName(left).repartitionByRange(parts, "prefix"), False)
    return found.unionByName(shared.filter("text is null"))


def failure_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit n: fails filter n of ``FILTERS``) of every row."""
    masks = own_masks(documents)
    known = masks.filter("text is null").select("doc_id", "part", "mask")
    firsts = trie_masks(masks.filter("text is not null")).select("doc_id", "part", "mask")
    return known.unionByName(firsts)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and the number n of rows that have them."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")
    )
    # A doc_id that many rows repeat is one row before it is joined.
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    no = F.lit(False)
    return (
        rows.join(marks, "doc_id", "left")
        .groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def order_steps(filters: str = FILTERS) -> Column:
    """All orders of the filters, step by step: the filter's bit, and those of the filters before it."""
    steps = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(steps)})")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` sums a filter's removals over all orders.  Of a row that fails k filters each of
    them removes it in one kth of the orders, so the sum is exact without going through them.
    """
    rows = counts.withColumn("at", F.explode(order_steps(filters))).select("*", "at.*")
    n, mask, bit = F.col("n"), F.col("mask"), F.col("bit")
    fails = mask.bitwiseAND(bit) != 0
    earlier = mask.bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def total(condition: Column, amount: Column = n) -> Column:
        return F.sum(F.when(condition, amount).otherwise(0)).cast("long")

    share = (n * (factorial(len(filters)) / F.bit_count(mask))).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Interactions of the five filters in each part (lang; null: empty string), one row per order and step.

    A null text is empty: too few words, and equal to other empty texts.  Rows that repeat the
    smallest doc_id of a text are no duplicates of each other; a null doc_id counts as larger than
    every other and has no label.  Of several labels for one document the largest counts.  Texts
    are read whole, other columns are not read; an empty table gives no rows.
    """
    return interactions(materialize(mask_counts(failure_masks(documents), labels), "filter-counts"))
