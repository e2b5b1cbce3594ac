import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from logweave.llm import exact_dedup, simhash
from logweave.session import scratch_path


def test_exact_dedup_matches_brute_force(make, odd_rows):
    found = exact_dedup.dedup_documents(make(odd_rows)).collect()
    groups = defaultdict(list)
    for doc, text in odd_rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(doc)
    assert len(found) == len(odd_rows)
    for row in found:
        group = groups[row.text_sha256]
        known = [d for d in group if d is not None]
        assert row.group_size == len(group)
        assert row.keep_id == (max(known) if known else None)
        assert not row.kept or row.doc_id == row.keep_id
    for digest in groups:
        assert sum(r.kept for r in found if r.text_sha256 == digest) == 1


def test_exact_dedup_empty(make):
    assert exact_dedup.dedup_documents(make([])).count() == 0
    assert exact_dedup.distinct_documents(make([])).count() == 0


def test_index_outlives_a_batch(spark, make):
    path = scratch_path(spark, "digest-index")
    exact_dedup.dedup(make([(1, "a"), (2, "b"), (3, "b")]), exact_dedup.DigestIndex(spark, path, 4))
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(make([(7, "b"), (8, "c")]), again).collect()}
    assert second == {7: (3, 3, False), 8: (8, 1, True)}
    assert again.totals().count() == 3
    plan = again.unseen(exact_dedup.group_digests(exact_dedup.digests(make([(9, "d")]))))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_third_batch_counts_all_batches(spark, make):
    path = scratch_path(spark, "digest-index")
    seen = []
    for rows in ([(1, "b"), (2, "b")], [(3, "b"), (None, "n")], [(4, "b"), (5, "n"), (5, "n"), (6, "new")]):
        seen.append(exact_dedup.dedup(make(rows), exact_dedup.DigestIndex(spark, path, 4)).collect())
    found = [[(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(rows, key=str)] for rows in seen]
    assert found[0] == [(1, 2, 2, False), (2, 2, 2, True)]
    assert found[1] == [(3, 2, 3, False), (None, None, 1, True)]
    assert found[2] == [(4, 2, 4, False), (5, None, 3, False), (5, None, 3, False), (6, 6, 1, True)]
    totals = sorted((str(r.keep_id), r.group_size) for r in exact_dedup.DigestIndex(spark, path, 4).totals().collect())
    assert totals == [("2", 4), ("6", 1), ("None", 3)]
    # What is new comes through the anti-join, and totals are summed without a shuffle of the index.
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert "Exchange" not in index.totals()._jdf.queryExecution().executedPlan().toString()


def test_distinct_documents_keep_columns(make, odd_rows):
    docs = make(odd_rows)
    found = exact_dedup.distinct_documents(docs)
    assert found.columns == docs.columns
    texts = [r.text or "" for r in found.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in odd_rows})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[n : n + 4]).encode(), 42) for n in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(values):
    values = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n in range(len(values)):
        for m in np.flatnonzero(np.bitwise_count(values[n] ^ values[n + 1 :]) <= 4):
            a, b = root(n), root(n + 1 + int(m))
            parent[max(a, b)] = min(a, b)
    return [root(n) for n in range(len(values))]


def test_simhash_matches_brute_force(make, odd_rows):
    found = simhash.near_duplicates(make(odd_rows)).collect()
    prints = [plain_fingerprint(t) for _, t in odd_rows]
    roots = plain_components(prints)
    smallest = defaultdict(lambda: None)
    for (doc, _), root in zip(odd_rows, roots):
        if doc is not None:
            smallest[root] = doc if smallest[root] is None else min(doc, smallest[root])
    expected = sorted((str(d), f"{p:016x}", str(smallest[r])) for (d, _), p, r in zip(odd_rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    kept = simhash.distinct_documents(make(odd_rows))
    assert kept.columns == make([]).columns and kept.count() == len(set(roots))


def test_simhash_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0


def test_blocks_skip_nothing(monkeypatch):
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[:700] ^ (np.uint64(1) << random.integers(0, 64, 700).astype(np.uint64)) ^ np.uint64(6)
    left, right = np.unique(base), np.unique(near)
    joined = np.concatenate([left, right])
    forest = simhash.Forest(len(joined))
    place = {int(v): n for n, v in enumerate(joined.tolist())}
    for links in (simhash.linked(left, right, False, 4), simhash.linked(left, left, True, 4), simhash.linked(right, right, True, 4)):
        forest.join(np.array([place[int(a)] for a, _ in links.tolist()], int), np.array([place[int(b)] for _, b in links.tolist()], int))
    mine = [forest.root(n) for n in range(len(joined))]
    brute = plain_components(joined)
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.vertex: r.root for r in simhash.components(edges).collect()}
    assert {roots[n] for n in range(201)} == {0} and roots[501] == roots[500] == 500
