"""The jobs from crawl files to reports."""

import random

import pytest

from mirepoix.plans import jobs
from mirepoix.sources import read_columnar, read_delimited, write_delimited


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    """30 users, 60 recipes, 12 ingredients, written as pipe-separated files."""
    folder = str(tmp_path_factory.mktemp("crawl"))
    rng = random.Random(11)
    users, recipes = range(1, 31), range(100, 160)

    def write(name, rows, schema):
        write_delimited(spark.createDataFrame(rows, schema), folder, name)

    pairs = [(r, u) for u in users for r in rng.sample(list(recipes), 12)]
    for name in ("favourites", "publications", "madeit"):
        write(name, [p for p in pairs if rng.random() < 0.6], "RECIPE_ID int, USER_ID int")
    reviews = [(i, r, u, rng.randint(1, 5)) for i, (r, u) in enumerate(pairs)] + [(9999, 777, 1, 5)]
    write("reviews", reviews, "ID int, RECIPE_ID int, AUTHOR_ID int, RATING int")
    write("recipes", [(r, f"recipe {r}") for r in recipes], "ID int, NAME string")
    write(
        "ingredients",
        [(i, r) for r in recipes for i in rng.sample(range(0, 13), 4)],
        "ID int, RECIPE_ID int",
    )
    write(
        "nutrition",
        [(r, str(r % 7 + 1), str(r % 5), "n/a" if r % 9 == 0 else "2") for r in recipes if r != 101],
        "RECIPE_ID int, CALORIES string, FAT string, IRON string",
    )
    return folder


@pytest.fixture(scope="module")
def dataset(spark, crawl, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dataset"))
    jobs.ingest_job(spark, crawl, folder)
    return folder


def test_ingest(spark, dataset):
    ingredients = read_delimited(spark, dataset, "ingredients")
    assert ingredients.columns == ["ID_INGREDIENT", "RECIPE_ID"] and ingredients.filter("ID_INGREDIENT = 0").count() == 0
    assert read_delimited(spark, dataset, "reviews").filter("RECIPE_ID = 777").count() == 0
    kinds = {r[0] for r in read_delimited(spark, dataset, "user-recipe").select("RECIPE_TYPE").distinct().collect()}
    assert kinds == {"fav", "recipes", "madeit", "review"}


def test_content_job(spark, dataset, tmp_path):
    recommender = jobs.content_job(spark, dataset, str(tmp_path), min_reviews=5, min_recipes=5)
    table = read_columnar(spark, str(tmp_path / "similarities"))
    assert table.count() == recommender.test.count() > 0
    assert table.filter("NUTRITION_SIMILARITY NOT BETWEEN 0 AND 1 OR IDF_SIMILARITY NOT BETWEEN 0 AND 1").count() == 0
    assert table.filter("RECIPE_ID = 101").count() == 0
    report = read_delimited(spark, str(tmp_path), "regressionEvaluation")
    assert {r.score for r in report.collect()} == {"avgN", "absI", "weightI", "absN", "weightN"}
    assert read_delimited(spark, str(tmp_path), "rawScoreEvaluation").count() == 5
    assert read_delimited(spark, str(tmp_path), "idf").count() == 12


def test_propagation_job(spark, dataset, tmp_path):
    jobs.propagation_job(spark, dataset, str(tmp_path), min_reviews=5, n_ratings=50)
    training, test = (read_columnar(spark, str(tmp_path / n)) for n in ("training", "test"))
    assert training.join(test, ["USER_ID", "RECIPE_ID"], "left_semi").count() == 0
    predictions = read_columnar(spark, str(tmp_path / "prediction"))
    assert 0 < predictions.count() <= 50
    assert predictions.filter("propR NOT BETWEEN 1 AND 5").count() == 0
    assert read_delimited(spark, str(tmp_path), "binaryEvaluation").count() == 1


def test_graph_job(spark, crawl, tmp_path):
    rows = read_delimited(spark, crawl, "ingredients").withColumnsRenamed({"ID": "ID_INGREDIENT", "RECIPE_ID": "ID_RECIPE"})
    write_delimited(rows, str(tmp_path), "baskets")
    jobs.graph_job(spark, str(tmp_path), "baskets", str(tmp_path / "out"), 5)
    edges = spark.read.csv(str(tmp_path / "out" / "graph.csv"), sep="\t")
    assert 0 < edges.count() <= 10
    assert spark.read.csv(str(tmp_path / "out" / "pmi_graph.csv"), sep="\t").count() == edges.count()


def test_names_job(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, "2 cups red onion"), (2, 7, "onion, sliced"), (3, 8, "Salt")],
                               "LINE_NO int, ID_INGREDIENT int, TEXT_VALUE string")
    write_delimited(df, str(tmp_path), "lines")
    jobs.names_job(spark, str(tmp_path), "lines", str(tmp_path))
    got = {r.ID_INGREDIENT: r.NAME for r in read_delimited(spark, str(tmp_path), "ingredient_names").collect()}
    assert got == {"7": "red sliced onion", "8": "Salt"}


def test_difficulty_job(spark, tmp_path):
    rng = random.Random(3)
    for site in ("north", "south"):
        rows = []
        for i in range(300):
            hard = rng.random() < 0.4
            rows.append((i, 90 + i % 9 if hard else 10 + i % 9, i % 6 + 1, i % 4 + 1, "hard" if hard else "easy"))
        df = spark.createDataFrame([*rows, (999, 0, 1, 1, "easy")], "ID int, a int, b int, c int, DIFFICULTY string")
        df = df.toDF("ID", "COOK_TIME", "#INGREDIENTS", "#STEPS", "DIFFICULTY")
        write_delimited(df, str(tmp_path / site), "recipes")
    jobs.difficulty_job(spark, str(tmp_path), ["north", "south"], str(tmp_path / "out"))
    assert read_columnar(spark, str(tmp_path / "out" / "union")).count() == 600
    accuracy = {r.model: float(r.accuracy) for r in read_delimited(spark, str(tmp_path / "out"), "accuracy").collect()}
    assert accuracy["tree"] > 0.9
    assert read_delimited(spark, str(tmp_path / "out"), "corr").columns[0] == "corr_#STEPS_#INGREDIENTS"
