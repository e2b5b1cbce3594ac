import math
from collections import Counter

from logweave.operators import retrieval
from logweave.plans.queries import QUERIES


def brute(texts):
    counts = {}
    for key, text in texts:
        counts.setdefault(key, Counter()).update((text or "").lower().split())
    df = Counter(w for c in counts.values() for w in c)
    found = {}
    for key, c in counts.items():
        own = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        found |= {(key, w): round(x / length, 6) for w, x in own.items()}
    return found


def weighed(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["chunk_vectors"](spark, str(folder))
    rows = found.collect()
    assert len({(r.doc_id, r.word) for r in rows}) == len(rows)
    return found, {(r.doc_id, r.word): r.weight for r in rows}


def close(found, wanted):
    return found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 2e-6 for k in wanted)


def shuffled_rows(node):
    """Rows that a plan that has run wrote to its shuffles; a shuffle that is used again counts once."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(node.plan())
    if name == "ReusedExchange":
        return 0
    own = node.metrics().get("shuffleRecordsWritten")
    children = node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_rows(children.apply(n)) for n in range(children.size()))


def test_no_row_per_text_and_word_is_shuffled(spark, tmp_path):
    words = [f"word{n}" for n in range(300)]
    texts = [(n, " ".join(words + [words[n]] * n)) for n in range(40)]
    found, weights = weighed(spark, tmp_path, texts)
    assert close(weights, brute(texts)) and len(weights) == 40 * 300
    # The texts, and twice the words of the one block.
    assert shuffled_rows(found._jdf.queryExecution().executedPlan()) <= 40 + 2 * 300


def test_repeated_and_null_ids_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "WORD_BLOCK_BYTES", 64)
    texts = [(n, f"all All part{n % 4}\tÉtat own{n} " * (n % 3 + 1)) for n in range(30)]
    texts += [(3, "all twice twice own3"), (None, "all nothing"), (None, "nothing part1"), (40, None), (41, " \t\n"), (42, "")]
    assert close(weighed(spark, tmp_path, texts)[1], brute(texts))


def test_words_that_one_text_has(spark, tmp_path):
    """No block is sent a word."""
    texts = [(1, "a b b"), (2, "c")]
    assert close(weighed(spark, tmp_path, texts)[1], brute(texts))


def test_no_words(spark, tmp_path):
    assert weighed(spark, tmp_path, [(1, None), (2, "")])[1] == {}


def test_nearest_texts_write_no_row_per_text_and_word(spark, monkeypatch):
    words = [f"word{n}" for n in range(300)]
    texts = [(n, " ".join(words + [words[n]] * (n + 1))) for n in range(40)]
    written = {}

    def counted(df, label, write=retrieval.materialize):
        written[label] = (found := write(df, label)).count()
        return found

    monkeypatch.setattr(retrieval, "materialize", counted)
    found = retrieval.nearest_texts(
        spark.createDataFrame(texts, "vec_id long, text string"),
        spark.createDataFrame([(0, "word7"), (1, "word39 word39")], "query_id long, text string"), 1,
    ).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(0, 7), (1, 39)}
    assert max(written.values()) <= 300
