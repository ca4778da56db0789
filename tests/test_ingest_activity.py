from pyspark.sql import functions as F

from mirepoix.operators import activity, ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_unify_interactions(spark):
    fav = spark.createDataFrame([("1", "10", "x")], "RECIPE_ID string, USER_ID string, EXTRA string")
    review = spark.createDataFrame([("20", "2")], "AUTHOR_ID string, RECIPE_ID string")
    got = ingest.unify_interactions({"fav": fav, "review": review}, {"review": "AUTHOR_ID"})
    assert got.columns == ["RECIPE_TYPE", "RECIPE_ID", "USER_ID"]
    assert rows(got) == [("fav", "1", "10"), ("review", "2", "20")]


def test_canonical_id(spark):
    df = spark.createDataFrame([("n", 1, 2)], "NAME string, ID int, X int")
    assert ingest.canonical_id(df, "RECIPE_ID").columns == ["RECIPE_ID", "NAME", "X"]


def test_drop_sentinel_on_text_ids(spark):
    df = spark.createDataFrame([("0",), ("1",), (None,), ("abc",), ("-1",)], "ID string")
    assert rows(ingest.drop_sentinel(df, "ID")) == [("-1",), ("1",)]
    assert ingest.bad_id_audit(df, "ID").head().asDict() == {"n_bad": 2, "n_rows": 5}


def test_bucket_types_null_is_review(spark):
    df = spark.createDataFrame([("fav",), ("madeit",), ("recipes",), ("review",), (None,)], "RECIPE_TYPE string")
    assert [r[0] for r in ingest.bucket_types(df.coalesce(1)).collect()] == ["recipes"] * 3 + ["reviews"] * 2


def test_dedupe_is_stable(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, 9, None)], "k int, o int, v string")
    want = [(1, 4, "z"), (2, 9, None)]
    for n in (1, 3, 7):
        assert rows(ingest.dedupe(df.repartition(n), ["k"], ["o"])) == want
    assert rows(ingest.dedupe(df, ["k"], [F.desc("o")])) == [(1, 5, "a"), (2, 9, None)]
    assert rows(ingest.dedupe(df.select("k"), ["k"])) == [(1,), (2,)]


def test_valid_recipes(spark):
    recipes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 1)], "RECIPE_ID int")
    ingredients = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (4, 7), (5, 7)], "RECIPE_ID int, ID_INGREDIENT int")
    nutrition = spark.createDataFrame(
        [(1, 10.0), (2, 0.0), (3, 5.0), (5, None), (4, 3.0), (4, 0.0)], "RECIPE_ID int, CALORIES double"
    )
    assert rows(ingest.valid_recipes(recipes, ingredients, nutrition)) == [(1,), (5,)]


def test_filter_dataset_does_not_fan_out(spark):
    keys = spark.createDataFrame([(1,), (1,), (2,)], "RECIPE_ID int")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (3, "b")], "RECIPE_ID int, v string")
    assert rows(ingest.filter_dataset(keys, {"t": df})["t"]) == [(1, "a"), (1, "a")]


def test_reviews_with_recipe_and_clean_authored(spark):
    reviews = spark.createDataFrame([(1, 10), (2, 99)], "ID int, RECIPE_ID int")
    recipes = spark.createDataFrame([(10,), (11,)], "ID int")
    assert rows(ingest.reviews_with_recipe(reviews, recipes).select("ID", "RECIPE_ID")) == [(1, 10)]
    authored = spark.createDataFrame([("1", "0"), ("1", "2"), ("1", "2")], "ID_RECIPE string, ID_AUTHOR string")
    assert rows(ingest.clean_authored(authored)) == [("1", "2")]


def test_exclusive_interactions(spark):
    df = spark.createDataFrame(
        [(1, 1, "recipes"), (1, 1, "reviews"), (1, 2, "recipes"), (2, 1, "reviews"), (2, 1, "reviews")],
        "USER_ID int, RECIPE_ID int, type string",
    )
    assert rows(ingest.exclusive_interactions(df)) == [(1, 2, "recipes"), (2, 1, "reviews"), (2, 1, "reviews")]


def test_user_stats_and_weights(spark):
    df = spark.createDataFrame([(1, "recipes", 3), (1, "reviews", 1), (2, "reviews", 2)], "USER_ID int, type string, N int")
    assert rows(activity.user_stats(df)) == [(1, 1, 1), (2, 0, 1)]
    assert rows(activity.user_stats(df, weight="N")) == [(1, 3, 1), (2, 0, 2)]


def test_pivot_sum_discovers_values(spark):
    df = spark.createDataFrame(
        [(0, 100, 4), (0, 101, 2), (1, 100, 3), (1, 102, 8), (2, 101, 5), (2, 103, 9)],
        "ID_USER int, ID_INGREDIENT int, times int",
    )
    got = activity.pivot_sum(df, "ID_USER", "ID_INGREDIENT", "times")
    assert got.columns == ["ID_USER", "100", "101", "102", "103"]
    assert rows(got) == [(0, 4, 2, 0, 0), (1, 3, 0, 8, 0), (2, 0, 5, 0, 9)]


def test_activity_curve(spark):
    df = spark.createDataFrame([(1,), (3,), (3,), (9,)], "total int")
    assert rows(activity.activity_curve(df, "total", 2, 5)) == [(2, 3), (3, 3), (4, 1), (5, 1)]


def test_role_activity(spark):
    df = spark.createDataFrame(
        [("1", "a", "author"), ("1", "a", "author"), ("1", "b", "author"), ("1", "a", "reviewer"),
         ("1", "a", "reviewer"), ("0", "c", "author")],
        "ID_USER string, ID_RECIPE string, ROLE string",
    )
    assert rows(activity.role_activity(df, "author", True)) == [("1", "a", "author", 2), ("1", "b", "author", 2)]
    assert rows(activity.role_activity(df, "reviewer", False)) == [("1", "a", "reviewer", 2)] * 2
    assert rows(activity.busiest_users(df, "reviewer", False)) == [("1", "reviewer", 2)]


def test_active_users_is_strict(spark):
    recipes = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2, "USER_ID int")
    reviews = spark.createDataFrame([(1,)] * 4 + [(2,)] * 9, "USER_ID int")
    assert rows(activity.active_users(recipes, reviews, 2)) == [(1, 3, 4)]


def test_class_counts_and_pair_statistics(spark):
    df = spark.createDataFrame([(0, "hard", 1.0, 2.0), (0, "easy", 2.0, 4.0), (1, None, 3.0, 6.0)],
                               "SOURCE int, DIFFICULTY string, a double, b double")
    assert rows(activity.class_counts(df)) == [(0, 2, 1, 0, 1), (1, 1, 0, 0, 0)]
    assert abs(activity.pair_statistics(df, [("a", "b")], "corr").head()[0] - 1.0) < 1e-12
    assert abs(activity.pair_statistics(df, [("a", "b")], "cov").head()[0] - 2.0) < 1e-12
