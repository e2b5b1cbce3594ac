"""Nearest vectors by cosine: exactly, block by block, or through an index of random projections.

The exact search multiplies blocks of vectors with blocks of queries; a task keeps the best ``k``
per query, so what is shuffled does not grow with the vectors that it has seen.  Blocks of queries
are rows of a table: while they are small they are broadcast to the vectors, otherwise vectors
and queries are dealt to the cells of a grid, each of bounded size.  No vector passes the driver.

The index puts a vector into one bucket per table, by the sides of some random planes that it lies
on.  A query looks into its own bucket and into those behind the planes that it lies closest to,
and its candidates are then compared exactly.  The index is written once and serves many batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.retrieval import TOP_K
from logweave.session import BROADCAST_BYTES, lookup_join, materialize

#: Vectors in a block.
BLOCK = 2048
#: Bytes of vectors, and of queries, in a cell of the grid.
CELL_BYTES = 64 << 20

#: Tables of an index, buckets of a table that a query looks into, vectors per bucket it is laid out for.
TABLES, PROBES, BUCKET = 10, 8, 32
SEED = 20

_FOUND = "query_id bigint, vec_id bigint, score double"


def _unit(column: pa.ListArray) -> np.ndarray:
    """Rows of length one; a vector of zeros stays one."""
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


class _Best:
    """The best ``k`` vectors of each query so far; at equal scores the smaller id comes first."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k, self.query_ids = k, ids
        self.query, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row per query and a column per id."""
        if scores.shape[1] > self.k:
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
            query, place = np.nonzero(scores >= least[:, None])
        else:
            query, place = (x.ravel() for x in np.indices(scores.shape))
        query = np.concatenate([self.query, query])
        found = np.concatenate([self.ids, ids[place]])
        value = np.concatenate([self.scores, scores[query[len(self.query) :], place]])
        order = np.lexsort((found, -value, query))
        begins = np.searchsorted(query[order], query[order])
        kept = order[np.arange(len(order)) - begins < self.k]
        self.query, self.ids, self.scores = query[kept], found[kept], value[kept]

    def batch(self) -> pa.RecordBatch:
        columns = [self.query_ids[self.query], self.ids, self.scores]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows (id, vector) as ids and a matrix of unit rows, in binary form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("id").to_numpy().astype("<i8").tobytes()
                matrix = _unit(part.column("vector")).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([matrix])], ["ids", "matrix"])

    return rows.filter("vector is not null").mapInArrow(run, "ids binary, matrix binary")


def _read_block(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(matrix, "<f8").reshape(len(own), -1)


def _against_broadcast(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every block of vectors against every block of a small set of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, _Best] = {}
        for batch in batches:
            for ids, matrix, query_ids, query_matrix in zip(*[c.to_pylist() for c in batch.columns]):
                names, rows = _read_block(ids, matrix)
                asked, unit = _read_block(query_ids, query_matrix)
                best.setdefault(query_ids, _Best(asked, k)).take(unit @ rows.T, names)
        for found in best.values():
            yield found.batch()

    asked = queries.select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    # The stated set of queries, in blocks, against all rows, in blocks.
    return _blocks(vectors, BLOCK).crossJoin(F.broadcast(asked)).mapInArrow(run, _FOUND)


def _against_grid(vectors: DataFrame, queries: DataFrame, k: int, rows: int, columns: int) -> DataFrame:
    """Vectors in ``rows`` groups and queries in ``columns`` groups; each pair of groups is a task's."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        asked, unit = right.column("id").to_numpy(), _unit(right.column("vector").combine_chunks())
        parts = []
        for at in range(0, len(asked), BLOCK):
            best = _Best(asked[at : at + BLOCK], k)
            for batch in left.to_batches(BLOCK):
                best.take(unit[at : at + BLOCK] @ _unit(batch.column("vector")).T, batch.column("id").to_numpy())
            parts.append(best.batch())
        return pa.Table.from_batches(parts)

    def group(rows: DataFrame, own: str, number: int, other: str, others: int) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        dealt = rows.filter("vector is not null").withColumn(own, F.pmod(F.xxhash64("id"), F.lit(number)).cast("int"))
        return dealt.withColumn(other, everywhere).groupBy("r", "c")

    left = group(vectors, "r", rows, "c", columns)
    return left.cogroup(group(queries, "c", columns, "r", rows)).applyInArrow(run, _FOUND)


def top_places(found: DataFrame, k: int) -> DataFrame:
    """``place`` of each vector among its query's, best first, up to ``k``."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    vector_id: str = "vec_id",
    query_id: str = "query_id",
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """``(query_id, vec_id, score, place)``: the ``k`` most similar vectors by cosine, exactly.

    ``vectors`` and ``queries`` hold an id (bigint) and ``vector``, all of one length; rows without
    a vector are left out.
    """
    rows = vectors.select(F.col(vector_id).cast("bigint").alias("id"), "vector")
    asked = materialize(queries.select(F.col(query_id).cast("bigint").alias("id"), "vector"), "queries")
    size = F.sum(8 * F.size("vector"))
    bytes_asked = asked.agg(size).first()[0] or 0
    if bytes_asked <= broadcast_bytes:
        blocks = materialize(_blocks(asked, BLOCK), "query_blocks")
        found = _against_broadcast(rows, blocks, k)
    else:
        bytes_held = rows.agg(size).first()[0] or 0
        found = _against_grid(rows, asked, k, -(-bytes_held // cell_bytes) or 1, -(-bytes_asked // cell_bytes))
    return top_places(found, k).withColumnsRenamed({"query_id": query_id, "vec_id": vector_id})


def _planes(length: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, tables * bits))


def bucket_rows(vectors: DataFrame, tables: int, bits: int, probes: int = 1) -> DataFrame:
    """``(id, table, bucket)``: a vector's bucket in each table, and the ``probes - 1`` next ones behind close planes."""
    flips = [flip for size in range(min(bits, 3) + 1) for flip in combinations(range(bits), size)]
    masks = np.array([sum(1 << bit for bit in flip) for flip in flips])
    cost = np.zeros((bits, len(flips)))
    for place, flip in enumerate(flips):
        cost[list(flip), place] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("vector"))
            sides = unit @ _planes(unit.shape[1], tables, bits)
            ids = batch.column("id").to_numpy()
            count = min(probes, len(flips))
            for table in range(tables):
                own = sides[:, table * bits : (table + 1) * bits]
                bucket = (own > 0) @ (1 << np.arange(bits))
                order = np.argsort(np.abs(own) @ cost, axis=1, kind="stable")[:, :count]
                found = bucket[:, None] ^ masks[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, count)), pa.array(np.full(found.size, table, np.int32)), pa.array(found.ravel().astype(np.int64))],
                    ["id", "table", "bucket"],
                )

    return vectors.filter("vector is not null").mapInArrow(run, "id bigint, table int, bucket bigint")


def _dot(a: str, b: str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


class VectorIndex:
    """Random-projection buckets of vectors, kept in a folder.

    ``postings`` (table, bucket, vec_id) lie sorted by bucket, one folder per table; ``vectors``
    (vec_id, vector) hold unit vectors.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, vectors: DataFrame, vector_id: str = "vec_id", tables: int = TABLES, bits: int | None = None) -> VectorIndex:
        """Write the index of all vectors; without ``bits``, buckets are laid out for ``BUCKET`` vectors each."""
        rows = materialize(
            vectors.select(F.col(vector_id).cast("bigint").alias("id"), "vector").filter("vector is not null"), "vectors"
        )
        count = rows.count()
        bits = bits or max(3, min(20, round(log2(max(1, count) / BUCKET))))
        length = F.sqrt(_dot("vector", "vector"))
        unit = F.transform("vector", lambda x: x.cast("double") / F.greatest(length, F.lit(1e-300)))
        rows.select(F.col("id").alias("vec_id"), unit.alias("vector")).write.mode("overwrite").parquet(f"{self.folder}/vectors")
        postings = bucket_rows(rows, tables, bits).withColumnRenamed("id", "vec_id").repartition("table", "bucket")
        postings.sortWithinPartitions("table", "bucket").write.mode("overwrite").partitionBy("table").parquet(f"{self.folder}/postings")
        layout = self.spark.range(1).select(F.lit(tables).alias("tables"), F.lit(bits).alias("bits"))
        layout.write.mode("overwrite").parquet(f"{self.folder}/layout")
        return self

    def nearest(self, queries: DataFrame, k: int = TOP_K, query_id: str = "query_id", probes: int = PROBES) -> DataFrame:
        """``(query_id, vec_id, score, place)``: the best ``k`` of the vectors in the buckets that a query looks into.

        All candidates are compared; fewer than ``k`` may be found.
        """
        layout = self.spark.read.parquet(f"{self.folder}/layout").first()
        asked = materialize(queries.select(F.col(query_id).cast("bigint").alias("id"), "vector").filter("vector is not null"), "queries")
        looked = bucket_rows(asked, layout.tables, layout.bits, probes)
        postings = self.spark.read.schema("bucket bigint, vec_id bigint, table int").parquet(f"{self.folder}/postings")
        pairs = lookup_join(postings, looked, ["table", "bucket"], "inner").select(F.col("id").alias("query_id"), "vec_id").distinct()
        length = F.sqrt(_dot("vector", "vector"))
        unit = F.transform("vector", lambda x: x.cast("double") / F.greatest(length, F.lit(1e-300)))
        asked = asked.select(F.col("id").alias("query_id"), unit.alias("_asked"))
        vectors = self.spark.read.parquet(f"{self.folder}/vectors")
        scored = lookup_join(pairs.join(vectors, "vec_id"), asked, ["query_id"], "inner")
        found = top_places(scored.select("query_id", "vec_id", _dot("vector", "_asked").alias("score")), k)
        return found.withColumnRenamed("query_id", query_id)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id") -> float:
    """Share of the exact pairs that were found."""
    keys = [query_id, "vec_id"]
    counts = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits")
    ).first()
    return counts.hits / counts.n if counts.n else 1.0
