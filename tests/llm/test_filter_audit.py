"""The audit against a plain walk through all orders, and the tries against sets."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from logweave.llm import filter_audit as audit


def own_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        name
        for name, fails in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
        }.items()
        if fails
    }


def failed_rows(rows):
    """(part, failed filters, doc_id) per row of (doc_id, text, lang)."""
    order = lambda key: 1 << 63 if key is None else key
    least = {}
    for key, text, _ in rows:
        least[text or ""] = min(order(key), least.get(text or "", 1 << 63))
    return [
        (lang or "", frozenset(own_failures(text or "") | ({"E"} if order(key) > least[text or ""] else set())), key)
        for key, text, lang in rows
    ]


def expected(rows, labels):
    labels = [row for row in labels if row[0] is not None]
    good, toxic = {k for k, q, t in labels if q == 1}, {k for k, q, t in labels if t == 1}
    failed, found = failed_rows(rows), {}
    for part in {p for p, _, _ in failed}:
        members = [(f, k) for p, f, k in failed if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                out = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                shapley[name] += len(out)
                found[part, "".join(order), step] = [
                    len(left), len(out), sum(name in f for f, _ in members) - len(out), sum(f == {name} for f, _ in members),
                    sum(k in good for _, k in out), sum(k in toxic for _, k in out), name,
                ]
        for (p, _, _), row in found.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return {key: tuple(row) for key, row in found.items()}


def documents(spark, rows):
    made = [(*r, 1, "x", True, 2, b"p") for r in rows]
    return spark.createDataFrame(
        made, "doc_id long, text string, lang string, mask int, part string, good boolean, n long, prefix binary"
    )


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def result(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_documents():
    random.seed(3)
    words = [f"w{n}" for n in range(300)]
    base = " ".join(random.choices(words, k=400))
    rows = [(n, base, random.choice(["en", "fr", None])) for n in range(40, 80)]
    rows += [(n, base[: 50 * n], "en") for n in range(1, 12)]
    rows += [(100 + n, base + f" end {n % 4}", "de") for n in range(12)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \n", ""), (203, "A#", "en"), (None, "A#", "en"), (None, "only", None)]
    rows += [(None, "only", None), (204, "twice", "en"), (204, "twice", "en"), (205, "twice", "fr"), (-1, "x" * 200_000, "en")]
    rows += [(206, "x" * 200_000 + "y", "en"), (207, "x" * 200_000, "en"), (208, "é & É", "en"), (209, "Éa b", "xx")]
    rows += [(300 + n, " ".join(random.choices(words, k=random.randint(150, 260))).upper(), "en") for n in range(10)]
    random.shuffle(rows)
    return rows


def odd_labels():
    rows = [(n, n // 2 % 2, int(n % 3 == 0)) for n in range(0, 320, 2)]
    return rows + [(41, 0, 1), (41, 1, None), (None, 1, 1), (43, None, None)]


def test_audit_of_odd_rows(spark):
    rows, labels = odd_documents(), odd_labels()
    found = result(audit.audit(documents(spark, rows), marks(spark, labels)))
    assert found == expected(rows, labels)
    assert len(found) == 600 * len({lang or "" for _, _, lang in rows})


def test_empty_table(spark):
    assert result(audit.audit(documents(spark, []), marks(spark, [(1, 1, 1)]))) == {}


def test_masks_do_not_depend_on_tries_and_tasks(spark):
    """Small local tries, many partitions and prefixes of a few texts give the same masks."""
    rows = odd_documents()
    bits = lambda names: sum(1 << audit.FILTERS.index(n) for n in names)
    plain = Counter((k, p, bits(f)) for p, f, k in failed_rows(rows))
    given = documents(spark, rows).repartition(13)
    local = audit.own_masks(given, trie_bytes=2_000)
    rest = audit.trie_masks(local.filter("text is not null")).unionByName(local.filter("text is null"))
    assert Counter((r.doc_id, r.part, r["mask"]) for r in rest.collect()) == plain


def test_prefixes_grow_until_they_part_the_texts(spark):
    start = "a shared beginning of many texts, " * 20
    rows = [(n, start + f"{n:05d} and its own end", "en") for n in range(300)] + [(1000 + n, f"{n} other", "en") for n in range(50)]
    texts = audit.own_masks(documents(spark, rows))
    limit = 5 * len(start)
    found = audit.adaptive_prefixes(texts, limit)
    assert found.selectExpr("startswith(text, prefix) AS same").filter("not same").count() == 0
    groups = found.selectExpr("prefix", "octet_length(text) AS n").groupBy("prefix").sum("n").collect()
    assert max(g[1] for g in groups) <= limit
    assert len(groups) > 100


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.tuples(st.text("ab", max_size=12), st.integers(0, 9)), max_size=40))
def test_trie_holds_the_least_ids(rows):
    trie, beaten = audit.Trie(), []
    for n, (text, key) in enumerate(rows):
        beaten += trie.insert(text.encode(), key, n)
    least = {}
    for text, key in rows:
        least[text] = min(key, least.get(text, 99))
    first = {n for n, (text, key) in enumerate(rows) if key == least[text]}
    held = [(t.decode(), r) for t, r in trie.held()]
    assert sorted(t for t, _ in held) == sorted(least)
    assert {n for _, r in held for n in r} == first
    assert sorted(beaten) == sorted(set(range(len(rows))) - first)


@pytest.mark.parametrize("text", ["", "a b", "a\tb\x0bc\x1cd", "A#é", "é" * 99 + "A" * 3, "é" * 97 + "A" * 3, "x " * 200, "x y " * 100 + "z"])
def test_failures_of_one_text(text):
    assert audit.failures(text.encode()) == sum(1 << "ABCD".index(n) for n in own_failures(text))
