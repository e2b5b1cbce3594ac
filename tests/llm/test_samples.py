import logging

from pyspark.sql import functions as F

from logweave.llm import quality_rules, toxicity
from logweave.llm.common import bounded_sample, labelled_sample

KINDS = "doc_id long, quality int, toxic int"


def many_labels(spark, own, others=200_000):
    """Labels of the given documents, and of many more that are not there."""
    far = spark.range(10**6, 10**6 + others).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")
    )
    return spark.createDataFrame(own, KINDS).unionByName(far)


def test_sample_comes_from_the_labels_at_hand(spark, make):
    docs = make([(n, f"text {n}") for n in range(300)])
    labels = many_labels(spark, [(n, n % 2, n % 3 == 0 and 1 or 0) for n in range(300)])
    kept = labelled_sample(docs, labels, "toxic", (1, 5), 1000).collect()
    assert len(kept) == 300 and {r.label for r in kept} == {0, 1}
    part = labelled_sample(docs, labels, "toxic", (1, 5), 100).collect()
    assert 60 < len(part) < 150
    assert sorted(part) == sorted(labelled_sample(docs, labels, "toxic", (1, 5), 100).collect())


def test_models_are_fitted_where_most_labels_lie_elsewhere(spark, make):
    """A batch that is a small part of a large table of labels."""
    bad = lambda n: n % 4 == 0
    word = lambda n: f"you vile scum number{n}" if bad(n) else f"a calm walk number{n}"
    docs = make([(n, " ".join([word(n)] * 3 + [f"and{k} so{n + k}" for k in range(30)])) for n in range(400)])
    labels = many_labels(spark, [(n, 0 if bad(n) else 1, int(bad(n))) for n in range(400)])
    stay = {r.doc_id for r in toxicity.clean_documents(docs, labels).collect()}
    assert sum(n not in stay for n in range(0, 400, 4)) > 90 and len(stay) > 290
    rows = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert sum(r.probability < 0.5 for r in rows if bad(r.doc_id)) > 90


def test_sample_of_a_tiny_share(spark):
    few = bounded_sample(spark.range(25_000_000).withColumnRenamed("id", "doc_id"), "doc_id", 20).count()
    assert 5 <= few <= 50


def test_repeated_rows_and_rare_labels(spark, make):
    rows = [(1, "same")] * 50 + [(1, "other")] + [(2, f"text {n}") for n in range(3000)] + [(n, "x") for n in range(3, 2000)]
    labels = spark.createDataFrame([(n, 1, int(n in (1, 500, 900))) for n in range(2000)], KINDS)
    found = labelled_sample(make(rows), labels, "toxic", (1, 5), 200).collect()
    # All of the rare label, each text of a document once, and no more rows where one id has many texts.
    assert sorted((r.doc_id, r.text) for r in found if r.label) == [(1, "other"), (1, "same"), (500, "x"), (900, "x")]
    assert len(found) < 300


def test_one_class_is_said(spark, make, caplog):
    docs = make([(n, f"text {n}") for n in range(10)])
    labels = spark.createDataFrame([(n, 1, 0) for n in range(10)], KINDS)
    with caplog.at_level(logging.WARNING):
        assert toxicity.clean_documents(docs, labels).count() == 10
    assert "no model for toxic" in caplog.text


def test_texts_of_a_sample_are_bounded_by_bytes(spark):
    from logweave.llm.common import bounded_bytes

    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 1000) AS text", "1 AS label")
    assert bounded_bytes(rows, 1 << 30).count() == 4000
    found = bounded_bytes(rows, 400_000).collect()
    assert 200 < len(found) < 700 and all(len(r.text) == 1000 for r in found)
    assert bounded_bytes(rows.limit(0), 10).count() == 0
