"""The manifest against a tree built by hand, and proofs that must fail."""

import hashlib
import random
import zlib

import pytest

from logweave.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mark(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return digest("".join(map(mark, row)))


def plain_lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests, arity):
    """Root of a list of digests, and for each the runs that it passes as (before, behind)."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, place in zip(paths, places):
            start = place - place % arity
            path.append(("".join(digests[start:place]), "".join(digests[place + 1 : start + arity])))
        digests = [digest("".join(digests[a : a + arity])) for a in range(0, len(digests), arity)]
        places = [p // arity for p in places]
    return digests[0], paths


def expected(rows, arity=16):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        members = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((members, *climb([leaf_of(r) for r in members], arity)))
    root, upper = climb([t[1] for t in trees], arity)
    found = []
    for (members, subroot, paths), above in zip(trees, upper):
        for row, path in zip(members, paths):
            path = path + above
            made = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                made = (*row[:4], plain_lower(row[4]))
            folded = leaf_of(made)
            for before, behind in path:
                folded = digest(before + folded + behind)
            proof = digest("".join(a + b for a, b in path))
            found.append((row[0], leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(found, key=str)


def given(spark, rows):
    made = [(*r, "clash", 7, b"x", 1) for r in rows]
    schema = "doc_id long, source string, lang string, n_chars long, text string, digest string, idx long, `left` binary, size int"
    return spark.createDataFrame(made, schema)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def many(counts):
    random.seed(11)
    rows, n = [], 0
    for source, count in counts:
        for _ in range(count):
            rows.append((n, source, random.choice(["en", None, "fr"]), random.choice([None, 5]), f"Text {n} é"))
            n += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity", [2, 16])
def test_trees_of_many_sizes(spark, arity):
    rows = many([("a", 1), ("B", 2), ("é", 17), (None, 40), ("", 16), ("hot", 300)])
    assert result(merkle.manifest(given(spark, rows), arity)) == expected(rows, arity)


def test_many_sources(spark):
    rows = many([(f"s{n}", 1 + n % 3) for n in range(40)])
    assert result(merkle.manifest(given(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, an empty and a long text, texts that a plain join would confuse."""
    rows = [
        (1, "s", "en", 3, None), (2, "s", "en", 3, ""), (3, None, None, None, None), (4, None, "-", None, "-"),
        (5, "s", "1:a", 1, "X" * 300_000), (5, "s", "1:a", 1, "other"), (6, "s", "en", 1, "Same"), (6, "s", "en", 1, "Same"),
        (None, "s", "en", 1, "No Key"), (None, "s", "en", 1, "No Key"), (None, None, "en", 2, "No Key"), (-7, "s", "a", 0, "ABC"),
    ]
    assert result(merkle.manifest(given(spark, rows))) == expected(rows)


def test_empty_table_and_single_row(spark):
    assert result(merkle.manifest(given(spark, []))) == []
    rows = [(9, "only", "en", 1, "A")]
    assert result(merkle.manifest(given(spark, rows))) == expected(rows)


def test_tampered_rows_fail_only_where_a_letter_changed(spark):
    rows = [(n, "s", "en", 1, "Big" if n % 2 else "small") for n in range(60)]
    found = {r.doc_id: r.verified for r in merkle.manifest(given(spark, rows)).collect()}
    changed = {n for n in range(60) if n % 2 and zlib.crc32(str(n).encode()) % 5 == 0}
    assert {n for n, ok in found.items() if not ok} == changed != set()


def test_numbers_do_not_depend_on_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_ROWS", 7)
    rows = many([("a", 60), ("b", 3), (None, 30)])
    assert result(merkle.manifest(given(spark, rows))) == expected(rows)
