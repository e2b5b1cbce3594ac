"""The registered queries and the pipeline's stages on the smallest tables."""

import pytest

import corpus_pipeline
from logweave.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from logweave.llm.common import read_table
from logweave.llm.queries import QUERIES, SQL
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", ["op1_html", "op3_url_filter"])
def test_page_queries(spark, name):
    assert QUERIES[name](spark, FOLDER).count() == read_table(spark, FOLDER, "pages").count()


@pytest.mark.parametrize("name", ["op5_toxicity", "op7_quality_conv", "op8_quality_rules", "op9_bpe"])
def test_document_queries(spark, name):
    assert QUERIES[name](spark, FOLDER).count() == read_table(spark, FOLDER, "documents").count()


def test_pipeline(spark):
    """Each stage against its operator, applied to the same documents."""
    docs, labels = read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert ids(clean) == ids(toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 0"))
    good = stages["quality_rules"](spark, clean, FOLDER)
    assert ids(good) == ids(quality_rules.judge(clean, quality_rules.train(clean, labels)).filter("kept"))
    distinct = stages["exact_dedup"](spark, good, FOLDER)
    assert ids(distinct) == ids(exact_dedup.dedup_documents(good).filter("kept"))
    apart = stages["simhash"](spark, distinct, FOLDER)
    assert ids(apart) == ids(simhash.near_duplicates(distinct).filter("doc_id = component_id"))
    assert all(s.columns == docs.columns for s in (clean, good, distinct, apart))
    pieces = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["packing"](spark, apart, FOLDER).collect()]
    assert sorted(pieces) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(apart).collect())
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run) == sorted(pieces)
