"""Personal data against a plain reading, and identifiers that only their contexts give away."""

import hashlib
import random
import re

import pytest

from logweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(d) if n % 2 == 0 else sum(map(int, str(2 * int(d)))) for n, d in enumerate(reversed(number))]
    return sum(doubled) % 10 == 0


def passes(kind, text):
    number = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 8 <= len(number) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m.group())
    ]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def documents(spark, rows):
    made = [(*r, 1, "x", True, 2, "s") for r in rows]
    return spark.createDataFrame(made, "doc_id long, text string, kind int, core string, valid boolean, `row` long, source string")


def check(found, rows):
    found = sorted(map(tuple, found.collect()), key=str)
    plain = []
    for key, text in rows:
        spans = base_spans(text)
        counts = [sum(k == kind for k, _, _ in spans) for kind in PLAIN]
        plain.append((key, *counts, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans)))
    assert found == sorted(plain, key=str)


def odd_texts():
    random.seed(7)
    signs = ["a", "b@c", ".", "@", "1", "22", "255", "256", ".", "+", "(", ")", "-", " ", "  ", "\n", "é", "😀", "%", "_", "4111111111111111", "+1 (377) 555-0271"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(300)]
    texts += [
        "", None, "a@b.c_d@e.f", "a@b-c@d.e", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "007.1.1.1 300.1.1.1 1.1.1.1.", "a@b a@b. a@b.c.",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "2023 4111 1111 1111 1111", "4 111111111111111 x", "1 2 3", "4111  111111111111",
        "+1 (377) 555-0271.", "+12", "+1234567", "+12345678", "+1 ((((", "+1.2.3.4 +123456789012345 +1234567890123456", "é😀 q@r.st 😀 10.0.0.1",
    ]
    return texts


def test_base_spans_of_odd_texts(spark):
    rows = list(enumerate(odd_texts())) + [(3, "a@b.cd"), (3, "a@b.cd"), (None, "a@b.cd 1.2.3.4"), (None, None)]
    check(pii.find(documents(spark, rows)), rows)


def test_long_runs_take_linear_time(spark):
    rows = [
        (1, "x" * 400_000), (2, "1" * 400_000), (3, "1." * 200_000), (4, "1 " * 200_000), (5, "+1 " + "(" * 300_000), (6, "a@" * 150_000),
        (7, "a.b" * 100_000 + "@"), (8, "a1 " * 150_000), (9, "10.0.0.1 " * 30_000), (10, "@" * 300_000),
    ]
    found = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert found[9].n_ip == 30_000 and found[9].spans.startswith("ip:0:8,ip:9:17,")
    assert found[3].n_ip == 50_000
    assert all(found[n].spans == "" for n in (1, 2, 4, 5, 6, 7, 8, 10))


def test_empty_table(spark):
    assert pii.find(documents(spark, [])).collect() == []


def contexts():
    """Phones after a cue; some are written in a way that no pattern knows."""
    random.seed(1)
    word = lambda: random.choice(["red", "blue", "green", "stone", "river", "cloud"]) + random.choice(["", "s", "ing"])
    rows = [(n, f"{word()} {word()} reach me: +1 (200) 555-{1000 + n} {word()} order {n + 50} {word()}") for n in range(40)]
    rows += [(n, f"{word()} mail {word()} person{n}@mail.example.com in {n * 7}") for n in range(40, 80)]
    unseen = [(100, "stone reach me: (200) 555-7777, red", "phone", "(200) 555-7777"), (101, "blue reach me: 200.555.8888", "phone", "200.555.8888")]
    elsewhere = [(102, "cloud 200.555.8888 river", "phone", "200.555.8888")]
    clean = [(103, "reach me: tomorrow at 12"), (104, "order 2005557777 of stone"), (105, "mail red 3 in 4"), (106, "reach me: room 12b")]
    return rows, unseen + elsewhere, clean


def test_contexts_give_unseen_identifiers(spark):
    rows, unseen, clean = contexts()
    given = rows + [r[:2] for r in unseen] + clean
    found = {r.doc_id: r for r in pii.find(documents(spark, given)).collect()}
    for key, text in rows + clean:
        assert found[key].spans == listed(base_spans(text)), text
    for key, text, kind, core in unseen:
        at = text.index(core)
        assert found[key].spans == f"{kind}:{at}:{at + len(core)}"
        assert found[key].n_phone == 0 and found[key].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_scores_are_those_of_a_plain_graph(spark):
    """The graph's scores against a walk over dictionaries."""
    rows, unseen, clean = contexts()
    given = rows + [r[:2] for r in unseen] + clean
    places = pii.placed(pii.matches(documents(spark, given)))
    instances = pii.phrases(places)
    induced, edges = pii.graph(instances, 4, 0.5)
    found = {(r.core, r.kind): r.score for r in pii.score_graph(induced, edges, 0.5, 3).collect()}
    members, seeds, forms = {}, {}, {}
    for r in instances.select("core", pii.lexical_patterns(instances.left, instances.right).alias("patterns"),
                              pii.seed_kind(instances.core).alias("seed"), pii.possible_kinds(instances.core).alias("may")).collect():
        seeds[r.core], forms[r.core] = r.seed, set(r.may)
        for pattern in r.patterns:
            members.setdefault(pattern, set()).add(r.core)
    scores = {}
    for _ in range(3):
        sure = {}
        for pattern, cores in members.items():
            for kind in range(4):
                known = sum(seeds[c] == kind for c in cores)
                score = (known + sum(scores.get((c, kind), 0) for c in cores)) / (len(cores) + 1)
                if known >= 4 and score >= 0.5:
                    sure[pattern, kind] = score
        scores = {}
        for core in seeds:
            for kind in forms[core] if seeds[core] is None else ():
                doubt = 1.0
                for (pattern, of), score in sure.items():
                    if of == kind and core in members[pattern]:
                        doubt *= 1 - score
                if doubt < 1:
                    scores[core, kind] = 1 - doubt
    assert found.keys() == scores.keys() and found
    assert all(abs(found[k] - scores[k]) < 1e-9 for k in scores)


@pytest.mark.parametrize("number,right", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("79927398713", True)])
def test_check_digit(spark, number, right):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(number)).alias("x")).first().x is right
