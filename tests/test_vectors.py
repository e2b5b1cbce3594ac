"""Nearest vectors against plain arithmetic, in blocks, in a grid and through the index."""

import numpy as np
import pytest

from logweave.operators import vectors as near


def frame(spark, matrix, name, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(matrix)), matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<double>")


def unit(matrix):
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def plain(vectors, queries, k):
    scores = unit(queries) @ unit(vectors).T
    return {(q, p + 1): int(v) for q in range(len(queries)) for p, v in enumerate(np.argsort(-scores[q].round(12), kind="stable")[:k])}


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "cell_bytes": 200}])
def test_exact_search(spark, monkeypatch, limits):
    draw = np.random.default_rng(4)
    vectors, queries = draw.normal(size=(60, 5)), draw.normal(size=(7, 5))
    # Equal vectors stand in the order of their ids, also across blocks.
    vectors[40] = vectors[11] = vectors[3]
    found = near.nearest(frame(spark, vectors, "vec_id").repartition(3), frame(spark, queries, "query_id"), 3, **limits)
    assert {(r.query_id, r.place): r.vec_id for r in found.collect()} == plain(vectors, queries, 3)


def test_ties_at_the_last_place():
    best = near._Best(np.array([7]), 2)
    best.take(np.array([[0.5, 0.5, 0.5]]), np.array([30, 10, 20]))
    best.take(np.array([[0.5, 0.1]]), np.array([5, 1]))
    assert best.ids.tolist() == [5, 10]


def test_odd_vectors(spark):
    none = frame(spark, [], "query_id")
    some = frame(spark, [[0.0, 0.0], None, [1.0, 0.0]], "vec_id")
    found = near.nearest(some, none)
    assert found.columns == ["query_id", "vec_id", "score", "place"] and found.count() == 0
    found = near.nearest(some, frame(spark, [[2.0, 0.0], None], "query_id"), 5).collect()
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in found] == [(0, 2, 1.0), (0, 0, 0.0)]
    assert near.nearest(frame(spark, [], "vec_id"), frame(spark, [[1.0, 2.0]], "query_id")).count() == 0


def test_index_finds_neighbours_and_serves_later_batches(spark, tmp_path):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 24))
    vectors = np.repeat(centres, 50, axis=0) + 0.3 * draw.normal(size=(2000, 24))
    held = frame(spark, vectors, "vec_id")
    folder = str(tmp_path / "index")
    near.VectorIndex(spark, folder).build(held)
    for batch in (vectors[::40], draw.normal(size=(20, 24))):
        asked = frame(spark, batch, "query_id")
        exact = near.nearest(held, asked, 10)
        found = near.VectorIndex(spark, folder).nearest(asked, 10)
        assert near.recall(found, exact) >= 0.9
        # What is found is compared exactly.
        scores = unit(batch) @ unit(vectors).T
        assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 for r in found.collect())
    rows = spark.read.parquet(f"{folder}/postings")
    assert rows.count() == near.TABLES * 2000
    # Candidates are a part of all pairs only.
    looked = near.bucket_rows(frame(spark, vectors[::40], "id"), near.TABLES, 6, near.PROBES)
    assert looked.count() == 50 * near.TABLES * near.PROBES


def test_one_bucket_may_hold_all(spark, tmp_path):
    """Equal vectors share every bucket; none of them is dropped."""
    held = frame(spark, [[1.0, 2.0, 3.0]] * 500 + [[-1.0, 0.5, 0.1]], "vec_id")
    index = near.VectorIndex(spark, str(tmp_path / "index")).build(held)
    found = index.nearest(frame(spark, [[1.0, 2.0, 3.0]], "query_id"), 600).collect()
    assert len([r for r in found if r.score > 0.999]) == 500
