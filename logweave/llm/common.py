"""What the operators of this subpackage share: reading tables, Arrow batches, stable splits."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import materialize

LOG = logging.getLogger(__name__)

#: Words: what lies between ASCII blanks, tabs and line ends.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A group is hot when it holds at least one part in so many of all rows.
HOT_SHARE = 1000

#: A label has at least one part in so many of a sample of labelled rows, if there are as many rows of it.
RARE_SHARE = 50

#: Bytes of text that a Python worker handles at a time.
BATCH_BYTES = 8 << 20


class Remembered(dict):
    """Values made on first use, of which at most two times ``limit`` are remembered.

    When the young half is full it becomes the old one; what is used again moves to the new
    young half, so frequent keys stay.  Keys longer than ``longest`` are made each time.
    """

    def __init__(self, make: Callable, limit: int = 150_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def hash_order(*keys: str) -> Column:
    """An order of rows that depends on the keys alone, for samples that repeat."""
    return F.xxhash64(*[F.col(key).cast("string") for key in keys], F.lit("sample"))


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice of several rows holds more than ``limit`` bytes."""
    if batch.nbytes <= limit:
        yield batch
        return
    start, held = 0, 0
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths = pc.binary_length(column).fill_null(0).to_pylist()
            sizes = [a + b for a, b in zip(sizes, lengths)]
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(
    df: DataFrame,
    columns: list[str],
    work: Callable[..., list[tuple]],
    schema: str,
    keep: tuple[str, ...] = (),
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Send ``columns`` of every row to Python in Arrow batches.

    ``work(values, state)`` gets one list of values per column of ``columns`` and returns one
    tuple of results per row, in order; ``schema`` names and types the results.  The columns
    in ``keep`` travel with the rows.  Only these columns are read from the source.  ``setup``
    builds the task's state once.
    """
    sent = list(dict.fromkeys([*keep, *columns]))
    fields = [part.strip().split(" ") for part in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kept = [f for f in df.select(*keep).schema.fields] if keep else []
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for batch in slices(whole):
                rows = work(*[batch.column(c).to_pylist() for c in columns], state)
                arrays = [batch.column(c) for c in keep]
                for place, (_, kind) in enumerate(fields):
                    arrays.append(pa.array([r[place] for r in rows], types[kind]))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *[name for name, _ in fields]])

    return df.select(*sent).mapInArrow(run, out_schema)


def hash_part(rows: int, total: int, *keys: str) -> Column:
    """True for about ``rows`` of ``total`` rows, by a 64-bit hash of the keys; for all if there are no more."""
    if total <= rows:
        return F.lit(True)
    return hash_order(*keys) < F.lit((rows << 64) // total - (1 << 63))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, chosen by the hash of ``key``: the same ones each time."""
    return df.filter(hash_part(rows, df.count(), key))


def bounded_bytes(df: DataFrame, limit: int) -> DataFrame:
    """Rows of ``df`` (doc_id, text), so many that their texts hold about ``limit`` bytes at most, chosen by hash."""
    size, rows = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return df if size <= limit else df.filter(hash_part(max(1, rows * limit // size), rows, "doc_id", "text"))


def class_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``bounded_sample`` of rows with a label, in which a rare label keeps a share of ``rows``.

    Labels are drawn in proportion, but of each at least a ``1 / RARE_SHARE`` part of ``rows``, or
    all rows that it has.
    """
    counts = {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total <= rows:
        return df
    chosen = F.lit(False)
    for label, n in counts.items():
        own = max(rows * n // total, rows // RARE_SHARE, 1)
        chosen = chosen | ((F.col("label") == label) & hash_part(own, n, *keys))
    return df.filter(chosen)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Bring each group's result (one row per ``key``, with its group_size) to its rows.

    Groups that hold at least a ``1 / HOT_SHARE`` part of all rows, so at most ``HOT_SHARE`` of
    them, are broadcast.  The rest, none of them large, is joined by a shuffle.
    """
    large = F.col("group_size") * HOT_SHARE >= total
    hot, rest = groups.filter(large), groups.filter(~large)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    done = marked.filter(F.col("_hot")).select(*columns)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return done.unionByName(others.join(rest, key).select(*columns))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], rows: int
) -> DataFrame:
    """doc_id, text and label (0 or 1) of about ``rows`` labelled documents at most.

    ``held_out`` is (parts, remainder): documents whose crc32(doc_id) modulo parts is that
    remainder are never taken.  Only labels of the given documents count, so the size of the
    table of labels does not matter: the two meet by doc_id alone, then labelled ids are sampled,
    so that their broadcast is bounded, and other texts are not shuffled.  Rows without a label
    are left out; of several labels for one document the largest counts.  Of repeated rows (same
    doc_id and text) one is taken, and where one doc_id has many texts these are sampled as well.
    """
    known = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.filter("label is not null and doc_id is not null")
    known = known.filter(remainder("doc_id", held_out[0]) != held_out[1])
    given = documents.select("doc_id").distinct()
    known = materialize(known.join(given, "doc_id", "left_semi"), "labelled-ids")
    sampled = class_sample(known, ["doc_id"], rows)
    found = documents.select("doc_id", "text").join(F.broadcast(sampled), "doc_id")
    found = found.withColumn("digest", text_digest()).dropDuplicates(["doc_id", "digest"])
    found = class_sample(materialize(found, "labelled-texts"), ["doc_id", "digest"], rows)
    return found.select("doc_id", "text", "label")


def one_class(target: Sequence, label: str) -> bool:
    """Whether labelled rows of both kinds are missing, so that no model can be fitted; says so in the log."""
    good = sum(target)
    if 0 < good < len(target):
        return False
    LOG.warning("no model for %s: %d labelled documents, %d of them 1; every text passes", label, len(target), good)
    return True


def text_digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def chosen_documents(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose doc_id and text digest are in ``chosen`` (doc_id, digest), with their columns.

    Rows that repeat a doc_id and text cannot be told apart; one of them stays.  ``chosen`` says
    in ``rows`` how many there are, so that only those are grouped again.  The columns travel in
    a struct, so that none of them clashes with the keys.
    """
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    keys = chosen.select(F.col("doc_id").alias("key"), "digest", "rows")
    text = F.sha2(F.coalesce(F.col("document.text"), F.lit("")), 256)
    same = F.col("document.doc_id").cast("long").eqNullSafe(F.col("key")) & (text == F.col("digest"))
    found = whole.join(keys, same)
    once = found.filter("rows = 1").select("document.*")
    repeated = found.filter("rows > 1").dropDuplicates(["key", "digest"]).select("document.*")
    return once.unionByName(repeated)


def keep_rows(documents: DataFrame, setup: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The documents whose text passes, with all their columns; ``setup`` builds a task's test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = setup()
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array([passes(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
