import math
import random
from collections import Counter

from logweave.operators import retrieval
from logweave.plans.answers import retrieved_answers
from logweave.operators.routing import RETRIEVE


def brute(texts, query, k):
    counts = {i: Counter(t.lower().split()) for i, t in texts}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) or 1.0
    asked = Counter(w for w in query.lower().split() if w in idf)
    score = lambda c: sum(n * c[w] * idf[w] ** 2 for w, n in asked.items()) / norm(c) / norm(asked)
    return [i for _, i in sorted((-round(score(c), 9), i) for i, c in counts.items())[:k]]


def varied(seed, n=1000):
    random.seed(seed)
    return [f"word{random.randrange(10**7)}" for _ in range(n)]


def test_equals_brute_force(spark):
    texts = [(n, " ".join(varied(n, 50) + ["common"] * (n % 3) + [f"part{n % 4}"])) for n in range(12)]
    asked = ["common part3", "part1 nothing part1 common", "unknown words only", texts[7][1]]
    found = retrieval.nearest_texts(
        spark.createDataFrame(texts, "vec_id long, text string"),
        spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 3,
    ).collect()
    for n, query in enumerate(asked):
        assert [r.vec_id for r in sorted(found, key=lambda r: r.place) if r.query_id == n] == brute(texts, query, 3)


def test_the_chunk_with_the_rare_word_is_found(spark):
    """Chunks full of varied words: in 256 buckets each word meets others."""
    rare = [f"needle{n}" for n in range(30)]
    lines = [("log", n, " ".join([*varied(n, 999), rare[n]])) for n in range(30)]
    routed = spark.createDataFrame(
        [(f"q{n}", f"what about {word}", RETRIEVE) for n, word in enumerate(rare)],
        "question_id string, question string, level2 string",
    )
    found = retrieved_answers(routed, spark.createDataFrame(lines, "log_id string, line_no long, line string")).collect()
    assert len(found) == 30 and all(r.n_matched == 2 for r in found)
    assert all(r.context[0].endswith(rare[int(r.question_id[1:])]) for r in found)


def test_no_row_is_made_for_a_pair(spark, monkeypatch):
    """A word in all texts and queries: only the best of each cell are written, and they are right."""
    monkeypatch.setattr(retrieval, "CELL_TEXTS", 20)
    monkeypatch.setattr(retrieval, "CELL_ASKED", 3)
    monkeypatch.setattr(retrieval, "CELL_QUERIES", 2)
    texts = [(n, " ".join(["all"] * (n % 7 + 1) + varied(n, 20) + [f"part{n % 9}"])) for n in range(60)]
    asked = [f"all part{n % 9} unknown{n}" for n in range(40)] + ["all all"] * 20 + ["none"]
    written = {}

    def counted(df, label, write=retrieval.materialize):
        written[label] = (found := write(df, label)).count()
        return found

    monkeypatch.setattr(retrieval, "materialize", counted)
    found = retrieval.nearest_texts(
        spark.createDataFrame(texts, "vec_id long, text string"),
        spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 2,
    ).collect()
    for n, query in enumerate(asked):
        assert [r.vec_id for r in sorted(found, key=lambda r: r.place) if r.query_id == n] == brute(texts, query, 2)
    assert len(found) == 2 * len(asked) and written["nearest"] == 2 * 10
