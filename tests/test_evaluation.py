import math
import random

import pytest
from pyspark.sql import functions as F

from mirepoix.operators import evaluation


def table(df, key="score"):
    return {r[key]: r.asDict() for r in df.collect()}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "RATING double, p double")


def test_regression(spark):
    got = table(evaluation.regression_metrics(frame(spark, [(5.0, 4.0), (3.0, 3.0), (1.0, 3.0), (2.0, None)]), "RATING", ["p"]))["p"]
    assert got["mse"] == pytest.approx(5 / 3)
    assert got["mae"] == pytest.approx(1.0)
    assert got["rmse"] == pytest.approx(math.sqrt(5 / 3))


def test_confusion_null_rules(spark):
    pairs = [(5.0, 5.0), (1.0, 1.0), (1.0, 4.0), (4.0, 2.0), (1.0, None), (5.0, None), (None, 5.0), (None, 1.0)]
    got = table(evaluation.confusion_metrics(frame(spark, pairs), "RATING", ["p"], 3, 3))["p"]
    # null score: TN for a low label, FN for a high one; null label: FP with a high score, FN with a low one
    assert (got["tp"], got["tn"], got["fp"], got["fn"]) == (1, 2, 2, 3)
    assert got["tp"] + got["tn"] + got["fp"] + got["fn"] == len(pairs)
    assert got["ppv"] == pytest.approx(1 / 3) and got["likelihood_ratio"] == pytest.approx(0.25 / 0.5)


def test_confusion_without_false_positives(spark):
    shown = evaluation.confusion_metrics(frame(spark, [(5.0, 5.0), (1.0, 1.0)]), "RATING", ["p"], 3, 3)
    assert table(shown)["p"]["likelihood_ratio"] is None
    assert table(evaluation.show_likelihood_ratio(shown))["p"]["likelihood_ratio"] == "MAX"
    some = evaluation.confusion_metrics(frame(spark, [(5.0, 5.0), (1.0, 5.0)]), "RATING", ["p"], 3, 3)
    assert table(evaluation.show_likelihood_ratio(some))["p"]["likelihood_ratio"] == "1.000"


def mllib(spark, pairs, cut=3):
    """Spark's own metrics on the cut values."""
    jvm = spark._jvm
    cut_rows = frame(spark, pairs).select(
        (F.col("p") >= cut).cast("double"), (F.col("RATING") >= cut).cast("double")
    )
    metrics = jvm.org.apache.spark.mllib.evaluation.BinaryClassificationMetrics(cut_rows._jdf)
    return metrics.areaUnderPR(), metrics.areaUnderROC()


CASES = {
    "mixed": [(5, 5), (4, 4), (1, 4), (4, 1), (2, 2)],
    "all_high": [(5, 5), (1, 5), (2, 4)],
    "all_low": [(5, 1), (1, 1), (2, 2)],
    "no_positive_label": [(1, 5), (2, 1)],
    "no_negative_label": [(5, 5), (4, 1)],
    "no_hit": [(5, 1), (1, 5), (2, 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_binary_areas_equal_mllib(spark, case):
    pairs = [(float(a), float(b)) for a, b in CASES[case]]
    got = table(evaluation.binary_metrics(frame(spark, pairs), "RATING", ["p"], 3, 3))["p"]
    pr, roc = mllib(spark, pairs)
    assert got["area_pr"] == pytest.approx(pr) and got["area_roc"] == pytest.approx(roc)


def test_binary_points(spark):
    pairs = [(float(a), float(b)) for a, b in CASES["mixed"]] + [(None, 5.0), (5.0, None)]
    got = table(evaluation.binary_metrics(frame(spark, pairs), "RATING", ["p"], 3, 3))["p"]
    assert got["area_roc"] == pytest.approx(0.583333, abs=1e-6) and got["area_pr"] == pytest.approx(0.655556, abs=1e-6)
    assert (got["precision_1"], got["recall_1"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (got["precision_0"], got["recall_0"], got["f1_0"]) == (0.6, 1.0, pytest.approx(0.75))
    one_sided = table(evaluation.binary_metrics(frame(spark, [(5.0, 5.0), (1.0, 5.0)]), "RATING", ["p"], 3, 3))["p"]
    assert one_sided["precision_0"] is None and one_sided["precision_1"] == 0.5


@pytest.fixture(scope="module")
def ranking(spark):
    # user 7 has four items with a tie, user 9 three and a null prediction, user 4 a single one
    rows = [
        (7, 31, 4, 3), (7, 12, 2, 5), (7, 25, 5, 1), (7, 40, 3, 3),
        (9, 12, 1, 4), (9, 40, 5, None), (9, 31, 3, 2),
        (4, 25, 2, 2),
    ]
    return spark.createDataFrame(rows, "u int, i int, label int, p int")


def test_precision_at_k(ranking):
    got = table(evaluation.precision_at_k(ranking, "u", "i", "label", ["p"], [1, 2], 3))["p"]
    # by prediction: user 7 has 12, 31, ...; user 9 has 12, 31, ...; user 4 has 25
    assert got["p_at_1"] == pytest.approx((0 + 0 + 0) / 3)
    assert got["p_at_2"] == pytest.approx((1 / 2 + 1 / 2 + 0) / 3)
    # worst first, user 7 begins with 25
    worst = table(evaluation.precision_at_k(ranking.filter("u = 7"), "u", "i", "label", ["p"], [1], 5, ascending=True))["p"]
    assert worst["p_at_1"] == 1.0


def test_prefix_agreement_and_overlap(ranking):
    own = ranking.filter("u = 7")
    got = evaluation.prefix_agreement(own, "u", "i", "label", "p", [1, 2]).head()
    # labels rank 25, 31, 40, 12 and predictions 12, 31, 40, 25
    assert (got.agreement_at_1, got.agreement_at_2) == (0.0, 0.0)
    overlap = evaluation.topk_overlap(own, "u", "i", "label", "p", [2, 4]).head()
    assert (overlap.overlap_at_2, overlap.overlap_at_4) == (pytest.approx(1 / 2), 1.0)


def test_overlap_of_disjoint_users_counts_as_zero(spark):
    df = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 1, 5), (2, 1, 5, 5)], "u int, i int, RATING int, p int")
    assert evaluation.topk_overlap(df, "u", "i", "RATING", "p", [1]).head()[0] == 0.5


def test_report_equals_its_parts(spark):
    rng = random.Random(5)
    data = [(u, i, rng.randint(1, 5), rng.randint(0, 5), rng.randint(0, 5)) for u in range(6) for i in range(12)]
    df = spark.createDataFrame(data, "USER_ID int, RECIPE_ID int, RATING int, a int, b int")
    report = table(evaluation.evaluation_report(df, "USER_ID", "RECIPE_ID", "RATING", ["a", "b"]))
    for i, s in enumerate(("a", "b")):
        hits = [(r[2] >= 3, r[3 + i] >= 3) for r in data]
        assert report[s]["tp"] == sum(x and y for x, y in hits)
        assert report[s]["mae"] == pytest.approx(sum(abs(r[2] - r[3 + i]) for r in data) / len(data))
        assert set(report[s]) >= {"area_pr", "p_at_5", "p_at_10", "p_at_30", "accuracy", "rmse"}


def test_top_k_beyond_the_limit_of_windows(spark):
    draw = random.Random(5)
    rows = [("hot", i, float(draw.randrange(40))) for i in range(3000)] + [("cold", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "user string, item int, value double")
    got = evaluation.top_k(df, ["user"], "value", "item", 1500, name="place")
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:1500]
    best = got.filter("user = 'hot'").orderBy("place").collect()
    assert [(r.item, r.place) for r in best] == [(r[1], i + 1) for i, r in enumerate(want)]
    assert [r.item for r in got.filter("user = 'cold'").orderBy("place").collect()] == list(range(20))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__shard" in plan and "__shard" not in got.columns
    assert "__shard" not in evaluation.top_k(df, ["user"], "value", "item", 1000)._jdf.queryExecution().optimizedPlan().toString()


def test_report_reads_predictions_twice(spark, tmp_path):
    rows = [(u, i, float(i % 5 + 1), float((i * u) % 5 + 1), None) for u in range(1, 6) for i in range(8)]
    spark.createDataFrame(rows, "u int, i int, r double, a double, b double").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    report = evaluation.evaluation_report(df, "u", "i", "r", ["a", "b"])
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    # b is never known: it has no curve and no row in the report, but counts and a ranking of its own
    assert [r.score for r in report.collect()] == ["a"]
    parts = evaluation.report_families(df, "u", "i", "r", ["a", "b"])
    for name, alone in {
        "regression": evaluation.regression_metrics(df, "r", ["a", "b"]),
        "binary": evaluation.binary_metrics(df, "r", ["a", "b"], 3, 3),
        "ranking": evaluation.precision_at_k(df, "u", "i", "r", ["a", "b"], (5, 10, 30), 3),
        "confusion": evaluation.confusion_metrics(df, "r", ["a", "b"], 3, 3),
    }.items():
        assert parts[name].columns == alone.columns
        assert sorted(map(str, parts[name].collect())) == sorted(map(str, alone.collect()))


def test_report_stages_what_it_reads(spark, monkeypatch):
    """Of the similarity table only keys and ratings are written, not the scores they were made of."""
    from types import SimpleNamespace

    from mirepoix.operators.similarity import SCORE_NAMES
    from mirepoix.plans import catalog

    ratings = [small for _, small in SCORE_NAMES.values()]
    columns = ["USER_ID", "RECIPE_ID", "RATING", *SCORE_NAMES, *ratings]
    table = spark.createDataFrame([(1, r, r % 5, *[0.5] * 5, *[r % 4] * 5) for r in range(8)], columns)
    monkeypatch.setattr(catalog, "content", lambda *_: SimpleNamespace(similarities=table))
    staged, stage = [], catalog.sources.stage
    monkeypatch.setattr(catalog.sources, "stage", lambda df, name: staged.append(df.columns) or stage(df, name))
    assert catalog.evaluation_report(spark, "").count() == 5
    assert staged == [["USER_ID", "RECIPE_ID", "RATING", *ratings]]
