import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import reports, scoring

IDS = ["id"]


def test_scores_by_hand(spark):
    pairs = [
        (1, "the cat sat", "the cat ran"),
        (2, "same words here", "same words here"),
        (3, "alpha beta", "gamma delta"),
        (4, "the of and", "the of and"),
        (5, "", ""),
        (6, "Ünïcode größe x", "GRÖSSE Ünïcode"),
    ]
    df = spark.createDataFrame(pairs, "id int, expected string, answer string")
    got = {r.id: (r.cosine, r.rouge1) for r in scoring.score_answers(df, IDS).collect()}
    w = 1 + math.log(1.5)
    assert got[1] == pytest.approx((1 / (1 + w * w), 2 / 3))
    assert got[2] == pytest.approx((1, 1)) and got[3] == (0, 0)
    assert got[4] == pytest.approx((0, 1)) and got[5] == (0, 0) and len(got) == 6
    assert 0 < got[6][0] < 1
    own = {r.id: r.cosine for r in scoring.score_answers(df, IDS, stop_words=[]).collect()}
    assert own[4] == pytest.approx(1)


def test_rows_of_one_pair_are_added_up(spark):
    rows = [(None, "the cat sat", "cat"), (None, "a dog", "dog dog"), (1, "x_1 zwei", None), (1, None, "zwei"), (2, "one", "one")]
    df = spark.createDataFrame(rows, "id int, expected string, answer string")
    got = {r.id: (r.cosine, r.rouge1) for r in scoring.score_answers(df, IDS).collect()}
    w = 1 + math.log(1.5)
    assert got == {
        None: pytest.approx((3 / math.sqrt((2 + w * w) * 5), 2 * 2 / 8)), 1: pytest.approx((1 / math.sqrt(1 + w * w), 2 / 4)), 2: (1, 1),
    }


def test_no_word_of_a_pair_becomes_a_row(spark):
    """Rows of words made a task's table of counts outgrow its memory."""
    df = spark.range(20).select("id", F.lit("one two").alias("expected"), F.lit("two three").alias("answer"))
    plan = scoring.score_answers(df, IDS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") == 1


def test_wide_answers_become_long(spark):
    df = spark.createDataFrame(
        [("A", 1, "x", "y", None), ("---B", 2, "x", "y", "z")], "sheet string, q int, expected string, m1 string, m2 string"
    )
    long = scoring.answers_long(scoring.finished_sheets(df), ["sheet", "q", "expected"])
    assert [(r.sheet, r.model, r.answer) for r in long.collect()] == [("A", "m1", "y")]


@pytest.mark.parametrize("ranges", [4, 64])
def test_exact_quantiles_against_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(reports, "QUANTILE_RANGES", ranges)
    draw = random.Random(2)
    groups = {
        "hot": [1.0] * 300 + [draw.random() for _ in range(100)],
        "few": [3.0, 1.0],
        "one": [5.0],
        "ties": [draw.choice([1.0, 2.0, 3.5]) for _ in range(99)],
        "wide": [draw.gauss(0, 1e6) for _ in range(257)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("few", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    found = reports.quantiles(df, ["g"], {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()
    assert len(found) == len(groups)
    for row in found:
        assert (row.q1, row.q2, row.q9) == pytest.approx(tuple(np.percentile(groups[row.g], [25, 50, 90])))
        assert row.n_values == len(groups[row.g])


# Published cosine scores, four sheets of seven categories, in report order.
# Columns are the models below.
COLUMNS = ["GPT-4o", "NotebookLM", "ChatPDF", "base-70b", "base-8b"]
COSINE = {
    "Apache": """.26 .20 .22 .41 .36   .12 .08 .07 .38 .05   .11 .14 .19 .49 .19   .32 .39 .26 .41 .09
                 .18 .19 .27 .59 .20   .47 .44 .47 .55 .51   .25 .10 .17 .46 .25""",
    "Linux": """.18 .13 .11 .56 .28   .15 .10 .20 .41 .33   .13 .12 .19 .43 .08   .48 .47 .50 .57 .52
                .21 .21 .35 .54 .21   .61 .33 .43 .47 .34   .26 .10 .09 .40 .28""",
    "Mac": """.17 .25 .23 .78 .33   .23 .22 .25 .40 .03   .18 .15 .21 .30 .06   .38 .59 .30 .51 .47
              .20 .18 .21 .45 .15   .32 .35 .38 .39 .42   .12 .12 .21 .45 .27""",
    "Windows": """.31 .31 .17 .40 .29   .10 .18 .11 .45 .18   .26 .28 .17 .29 .23   .39 .32 .28 .49 .30
                  .30 .30 .21 .34 .38   .41 .41 .46 .46 .43   .17 .12 .10 .41 .06""",
}
# Published two-decimal means of the other score, same order.
ROUGE_MEANS = """.29 .29 .25 .54 .36   .27 .26 .26 .41 .21   .26 .26 .27 .42 .19   .32 .33 .28 .45 .30
                 .29 .22 .29 .46 .25   .31 .20 .22 .41 .29   .18 .08 .09 .42 .18"""


def table(spark, sheets, metric):
    rows = []
    for sheet, text in sheets.items():
        values = [float(v) for v in text.split()]
        assert len(values) == 35
        for place, value in enumerate(values):
            rows.append((sheet, reports.CATEGORIES[place // 5], COLUMNS[place % 5], metric, value))
    return spark.createDataFrame(rows, "sheet string, category string, model string, metric string, value double")


@pytest.fixture(scope="module")
def cosine(spark):
    return table(spark, COSINE, scoring.COSINE).cache()


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_published_model_means(cosine):
    means = by(reports.model_means(cosine), "model", "value")
    expected = {"base-70b": 0.4568, "GPT-4o": 0.2596, "base-8b": 0.2604, "ChatPDF": 0.2432, "NotebookLM": 0.2421}
    assert means == pytest.approx(expected, abs=6e-5)
    assert by(reports.model_means(cosine), "model", "place")["base-8b"] == 2


def test_published_improvements(cosine):
    overall = reports.overall_improvement(cosine, "base-70b")
    expected = {"base-8b": 43.00, "GPT-4o": 43.16, "ChatPDF": 46.76, "NotebookLM": 46.99}
    assert by(overall, "model", "improvement") == pytest.approx(expected, abs=6e-3)
    assert overall.first().mean_improvement == pytest.approx(44.98, abs=6e-3)


def test_published_category_improvements(spark, cosine):
    means = reports.category_mean(cosine).unionByName(
        reports.category_mean(table(spark, {"mean": ROUGE_MEANS}, scoring.ROUGE))
    )
    per_category = reports.category_improvement(means, "base-70b")
    found = {(r.category, r.metric): r.improvement for r in per_category.collect()}
    assert found[("Summarization", scoring.COSINE)] == 56.02
    assert found[("Log Filtering and Search", scoring.ROUGE)] == 68.45
    assert found[("Log Understanding and Interpretation", scoring.COSINE)] == 10.64
    totals = by(reports.total_improvement(per_category), "metric", "improvement")
    assert totals == pytest.approx({scoring.COSINE: 46.00, scoring.ROUGE: 43.78}, abs=6e-3)
    ranked = reports.category_ranking(per_category).orderBy("place").collect()
    assert [r.category for r in ranked[:3]] == ["Log Filtering and Search", "Pattern Extraction", "Summarization"]
    assert ranked[0].improvement == pytest.approx(64.75)


def test_published_task_ranking(cosine):
    tasks = reports.task_ranking(cosine, "base-70b").orderBy("place").collect()
    assert [r.category for r in tasks][:3] == ["Summarization", "Root Cause Analysis", "Predictive Failure Analysis"]
    assert [round(r.value, 4) for r in tasks] == [0.5375, 0.4950, 0.4800, 0.4675, 0.4300, 0.4100, 0.3775]


def test_published_spread(cosine):
    keys = ["model", "metric"]
    medians = by(reports.medians(cosine, keys), "model", "median")
    assert medians == pytest.approx(
        {"GPT-4o": 0.24, "NotebookLM": 0.205, "ChatPDF": 0.21, "base-70b": 0.45, "base-8b": 0.275}
    )
    assert reports.iqr_narrowing(cosine, "base-70b").first().narrowing == pytest.approx(66.45, abs=6e-3)
    out = {}
    for r in reports.outliers(cosine, keys).collect():
        out.setdefault(r.model, []).append(r.value)
    assert {m: sorted(v) for m, v in out.items()} == {"GPT-4o": [0.61], "ChatPDF": [0.46, 0.47, 0.50], "base-70b": [0.78]}
    share = by(reports.outlier_share(cosine, keys), "model", "percent")
    assert share["ChatPDF"] == pytest.approx(10.71, abs=6e-3) and share["NotebookLM"] == 0
    final = reports.final_robustness(cosine, "base-70b").first()
    assert final.percent == pytest.approx(14.35, abs=6e-3) and final.label == "wider"
    per_category = reports.category_robustness(cosine, "base-70b")
    assert per_category.count() == 7


def test_pivots(spark, cosine):
    wide = reports.pivot_by_category(cosine, [*COLUMNS, "missing"])
    row = wide.filter("sheet = 'Mac' and position = 1").first()
    assert row["base-70b Cosine Similarity"] == 0.78 and row["missing Cosine Similarity"] is None
    assert wide.count() == 28
    by_model = reports.pivot_by_model(cosine).filter("sheet = 'Linux' and model = 'ChatPDF'").first()
    assert by_model["Cosine Similarity (Root Cause Analysis)"] == 0.5
    assert by_model["ROUGE-1 F1 (Root Cause Analysis)"] is None
    back = reports.wide_to_metrics(wide.drop("position"))
    assert back.exceptAll(cosine.select(back.columns)).count() == 0 and back.count() == 140


def test_groups_with_a_null_key_stay(spark):
    rows = [("s", None, 1.0), ("s", None, 2.0), ("s", None, 90.0), ("s", "b", 3.0)] + [("s", None, 1.5)] * 5
    df = spark.createDataFrame(rows, "sheet string, category string, value double")
    found = {r.category: (r.n_values, r.median) for r in reports.medians(df, ["category"]).collect()}
    assert found == {None: (8, 1.5), "b": (1, 3.0)}
    shares = {r.category: (r.n_values, r.n_outliers) for r in reports.outlier_share(df, ["category"]).collect()}
    assert shares[None][0] == 8 and shares[None][1] >= 1 and shares["b"] == (1, 0)
    assert reports.box_stats(df, ["category"]).count() == 2
