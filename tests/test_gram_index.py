"""Words looked up in a gram index against a plain search."""

import random

import pytest

from logweave.operators import gram_index
from logweave.operators.search import KeywordSets, line_words


def texts():
    random.seed(6)
    made = ["".join(random.choices("abcde Éı ", k=random.randint(0, 14))) for _ in range(600)]
    return made + ["", "x", "Rare NEEDLE here", "needle", "nee", "x" * 5000 + "tail"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(f"log{n % 2}", n // 2 + 1, t) for n, t in enumerate(texts())]
    lines = spark.createDataFrame(rows, "log_id string, line_no bigint, line string")
    folder = str(tmp_path_factory.mktemp("grams"))
    gram_index.BLOCK_LINES, keep = 8, gram_index.BLOCK_LINES
    gram_index.PART_BLOCKS, parts = 4, gram_index.PART_BLOCKS
    index = gram_index.GramIndex(spark, folder).build(lines)
    yield lines, index
    gram_index.BLOCK_LINES, gram_index.PART_BLOCKS = keep, parts


WORDS = ["needle", "nee", "a", "", "tail", "xxxxx", "nowhere", "b c", "é", "abcd", "ı", "edle h"]


def test_words_against_a_plain_search(spark, indexed):
    lines, index = indexed
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    plain = {(r.log_id, r.line_no): sorted(r.words) for r in line_words(lines, words).collect()}
    found = {(r.log_id, r.line_no): sorted(r.words) for r in index.line_words(words).collect()}
    assert found == plain


def test_only_hit_parts_and_blocks_are_read(spark, indexed):
    _, index = indexed
    words = spark.createDataFrame([("needle",), ("nowhere",)], "word string")
    blocks = index.blocks(words)
    hits = {(r.log_id, r.block) for r in blocks.collect()}
    where = {(f"log{n % 2}", (n // 2 + 1) // 8) for n, t in enumerate(texts()) if "needle" in t.lower()}
    assert where <= hits and len(hits) <= 2 * len(where)
    parts = index.read_parts(blocks.withColumn("part", blocks.block.cast("long") / 4).selectExpr("cast(floor(part) as bigint) part"))
    assert "PartitionFilters: []" not in parts._jdf.queryExecution().executedPlan().toString()
    files = lambda rows: rows.select("_metadata.file_path").distinct().count()
    assert files(parts) < files(index.lines()) / 3


def test_batches_of_questions_share_an_index(spark, indexed):
    lines, index = indexed
    for keywords in (["Needle", "tail"], ["a"], ["nowhere"]):
        asked = spark.createDataFrame([(1, keywords)], "question_id bigint, keywords array<string>")
        plain = sorted(map(tuple, KeywordSets(lines, asked).matches().collect()))
        assert sorted(map(tuple, KeywordSets(lines, asked, index=index).matches().collect())) == plain


def test_a_line_gets_its_text_before_it_is_handed_to_sets(spark, indexed):
    lines, index = indexed
    asked = spark.createDataFrame([(n, ["a", f"{n}"]) for n in range(40)], "question_id bigint, keywords array<string>")
    plan = KeywordSets(lines, asked, index=index).matches()._jdf.queryExecution().optimizedPlan().toString()
    assert "earlier" in next(row for row in plan.splitlines() if "Join " in row)


def test_words_meet_the_lines_that_hold_their_grams(spark, indexed, monkeypatch):
    """Words that share a block meet only the lines of their grams: no row lists a block's words."""
    lines, index = indexed
    kept = {}

    def seen(df, label, write=gram_index.materialize):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(gram_index, "materialize", seen)
    words = [f"{a}{b}{c}{d}" for a in "abcde" for b in "abcde" for c in "abcde" for d in "abcde"]
    found = index.line_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    plain = {(r.log_id, r.line_no): sorted(r.words) for r in line_words(lines, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {(r.log_id, r.line_no): sorted(r.words) for r in found} == plain
    assert set(kept["index-hits"].columns) == {"log_id", "block", "part"}
