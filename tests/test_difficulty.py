import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mirepoix.operators import difficulty, sampling


@pytest.fixture(scope="module")
def data(spark):
    hard = F.col("id") % 3 == 0
    return spark.range(900).select(
        F.col("id").alias("ID"),
        F.when(hard, 100 + F.col("id") % 7).otherwise(10 + F.col("id") % 7).cast("int").alias("COOK_TIME"),
        (F.col("id") % 5 + 1).cast("int").alias("N_INGREDIENTS"),
        (F.col("id") % 4 + 1).cast("int").alias("N_STEPS"),
        F.when(hard, "hard").otherwise("easy").alias("DIFFICULTY"),
    )


def test_dataset_union_casts_and_filters(spark):
    schema = "COOK_TIME string, N_INGREDIENTS string, N_STEPS string, DIFFICULTY string, EXTRA int"
    a = spark.createDataFrame([("10", "3", "2", "easy", 1), ("0", "3", "2", "easy", 1)], schema)
    b = spark.createDataFrame([("n/a", "3", "2", "hard", 1), ("7", "x", "2", "hard", 1)], schema)
    got = difficulty.difficulty_dataset({"a": a, "b": b})
    assert sorted(map(tuple, got.collect()), key=str) == [(10, 3, 2, "easy"), (7, None, 2, "hard")]


def test_label_index_orders_by_frequency(data):
    assert {r.DIFFICULTY: (r.indexedLabel, r.n) for r in difficulty.label_index(data).collect()} == {
        "easy": (0.0, 600),
        "hard": (1.0, 300),
    }


@pytest.mark.parametrize("kind", ["tree", "bayes"])
@pytest.mark.parametrize("max_categories", [None, 4])
def test_classifiers_beat_the_majority(data, kind, max_categories):
    if kind == "bayes" and max_categories:
        pytest.skip("categories are a matter of the tree")
    labels = difficulty.fit_label_index(data)
    training, test = sampling.fraction_split(data, ["ID"])
    assert training.intersect(test).count() == 0 and training.count() + test.count() == data.count()
    model = difficulty.fit_classifier(training, labels, kind, max_categories=max_categories)
    predictions = model.transform(test)
    got = difficulty.accuracy(predictions)
    assert got > 2 / 3
    row = difficulty.accuracy_table({kind: predictions}).head()
    assert row.accuracy == pytest.approx(got) and row.n == test.count()
    if kind == "tree":
        assert "If (feature" in difficulty.tree_description(model)


def test_unknown_classifier(data):
    with pytest.raises(ValueError):
        difficulty.fit_classifier(data, difficulty.fit_label_index(data), "forest")


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0)], "a double, b double, c double")
    got = {(r.a, r.b): r["corr"] for r in difficulty.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == pytest.approx(-0.5) and got["c", "c"] == 1.0


def test_pca_keeps_the_distances(spark):
    points = [[-1.5, 0.25, 8.0, 2.0], [3.0, -6.5, 0.5, 1.0], [0.0, 2.75, -4.0, 9.5]]
    df = spark.createDataFrame(list(enumerate(points)), "id int, v array<double>")
    got = {r.id: (r.pc1, r.pc2, r.pc3) for r in difficulty.pca(df, "v", 3, ["id"]).collect()}
    # three points span a plane, which three components reproduce exactly
    for i in range(3):
        for j in range(3):
            want = sum((x - y) ** 2 for x, y in zip(points[i], points[j]))
            assert sum((x - y) ** 2 for x, y in zip(got[i], got[j])) == pytest.approx(want)
