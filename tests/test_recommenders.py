import math

import pytest
from pyspark.sql import functions as F

from mirepoix.operators import profiles, propagation, sampling, similarity


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def kitchen(spark):
    return {
        "training": spark.createDataFrame([(1, 100), (1, 101), (2, 100)], "USER_ID int, RECIPE_ID int"),
        "ingredients": spark.createDataFrame(
            [(100, 7), (100, 8), (101, 7), (102, 7), (102, 9), (103, 9)], "RECIPE_ID int, ID_INGREDIENT int"
        ),
        "recipes": spark.createDataFrame([(r,) for r in range(100, 110)], "RECIPE_ID int"),
        "nutrition": spark.createDataFrame(
            [(100, 1.0, 3.0), (101, 3.0, None), (102, 3.0, 4.0), (103, 0.0, 0.0)],
            "RECIPE_ID int, FAT double, IRON double",
        ),
    }


def test_idf_and_profile(kitchen):
    idf = profiles.ingredient_idf(kitchen["recipes"], kitchen["ingredients"])
    want_idf = {7: round(math.log10(10 / 3), 4), 8: 1.0, 9: round(math.log10(5), 4)}
    assert {r.ID_INGREDIENT: r.IDF for r in idf.collect()} == want_idf
    got = profiles.ingredient_profile(kitchen["training"], kitchen["ingredients"], idf, relative=True)
    assert rows(got) == [
        (1, 7, 2, round(2 * want_idf[7], 4), 1.0),
        (1, 8, 1, 1.0, 0.5),
        (2, 7, 1, want_idf[7], 1.0),
        (2, 8, 1, 1.0, 1.0),
    ]


def test_nutrition_profiles(kitchen):
    average = profiles.nutrition_profile(kitchen["training"], kitchen["nutrition"])
    assert rows(average) == [(1, 2.0, 3.0), (2, 1.0, 3.0)]
    total = profiles.nutrition_profile(kitchen["training"], kitchen["nutrition"], "sum")
    assert rows(total) == [(1, 4.0, 3.0), (2, 1.0, 3.0)]


def test_nutrition_similarity_edges(spark, kitchen):
    pairs = spark.createDataFrame([(1, 102), (1, 103), (1, 999), (9, 102)], "USER_ID int, RECIPE_ID int")
    profile = profiles.nutrition_profile(kitchen["training"], kitchen["nutrition"])
    got = {(r[0], r[1]): r[2] for r in similarity.nutrition_similarity(pairs, profile, kitchen["nutrition"]).collect()}
    assert got[1, 102] == pytest.approx((2 * 3 + 3 * 4) / (math.sqrt(13) * 5))
    assert got[1, 103] is None and got[9, 102] is None
    assert got[1, 999] == 0.0


def test_ingredient_similarity_edges(spark, kitchen):
    pairs = spark.createDataFrame([(1, 102), (1, 103), (1, 999), (9, 102)], "USER_ID int, RECIPE_ID int")
    idf = profiles.ingredient_idf(kitchen["recipes"], kitchen["ingredients"])
    profile = profiles.ingredient_profile(kitchen["training"], kitchen["ingredients"], idf)
    got = {(r[0], r[1]): r[2:] for r in similarity.ingredient_similarity(pairs, profile, kitchen["ingredients"]).collect()}
    w7 = round(2 * round(math.log10(10 / 3), 4), 4)
    assert got[1, 102][0] == pytest.approx(2 / (math.sqrt(5) * math.sqrt(2)))
    assert got[1, 102][1] == pytest.approx(w7 / (math.sqrt(w7**2 + 1) * math.sqrt(2)))
    assert got[1, 103] == (0.0, 0.0)
    assert got[1, 999] == (0.0, 0.0)
    assert got[9, 102] == (None, None)


def test_similarity_table_columns_and_bounds(spark, kitchen):
    test = spark.createDataFrame([(1, 102, 4), (2, 101, 5)], "USER_ID int, RECIPE_ID int, RATING int")
    idf = profiles.ingredient_idf(kitchen["recipes"], kitchen["ingredients"])
    table = similarity.similarity_table(
        test,
        kitchen["nutrition"],
        kitchen["ingredients"],
        profiles.nutrition_profile(kitchen["training"], kitchen["nutrition"]),
        profiles.ingredient_profile(kitchen["training"], kitchen["ingredients"], idf),
    )
    assert table.columns[:3] == ["USER_ID", "RECIPE_ID", "RATING"] and len(table.columns) == 18
    for r in table.collect():
        for raw, (scaled, rating) in similarity.SCORE_NAMES.items():
            assert 0 <= r[raw] <= 1 and r[scaled] == pytest.approx(5 * r[raw]) and 0 <= r[rating] <= 5


def test_dense_cosine(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0, 4.0)], "a double, b double, c double, d double")
    assert similarity.dense_cosine(df, ["a", "b"], ["c", "d"]).head().cosine == pytest.approx(1.0)


def test_propagation_by_hand(spark, kitchen):
    training = spark.createDataFrame([(1, 100, 5), (1, 101, 2), (2, 103, 1)], "USER_ID int, RECIPE_ID int, RATING int")
    learnt = propagation.propagated_ratings(training, kitchen["ingredients"])
    assert rows(learnt) == [(1, 7, 3.5), (1, 8, 5.0), (2, 9, 1.0)]
    test = spark.createDataFrame([(1, 102, 4), (1, 103, 4), (2, 102, 3)], "USER_ID int, RECIPE_ID int, RATING int")
    got = propagation.propagation_predict(test, kitchen["ingredients"], learnt)
    assert rows(got) == [(1, 102, 4, 3.5, 4), (2, 102, 3, 1.0, 1)]


def test_mean_of_whole_number_is_not_rounded_up(spark):
    ratings = spark.createDataFrame([(1, i, 3.3 if i % 2 else 2.7) for i in range(10)], "USER_ID int, ID_INGREDIENT int, INGR_RATING double")
    ingredients = spark.createDataFrame([(5, i) for i in range(10)], "RECIPE_ID int, ID_INGREDIENT int")
    test = spark.createDataFrame([(1, 5)], "USER_ID int, RECIPE_ID int")
    assert propagation.propagation_predict(test, ingredients, ratings).head().propR == 3


def test_percent_split_invariants(spark):
    reviews = spark.range(4000).select((F.col("id") % 40).cast("int").alias("USER_ID"), F.col("id").alias("RECIPE_ID"))
    few = spark.createDataFrame([(99, 1), (99, 2)], "USER_ID int, RECIPE_ID bigint")
    split = sampling.percent_split(reviews.unionByName(few), 10)
    assert split.filter("USER_ID = 99").count() == 0 and split.count() == 4000
    train = split.filter("SPLIT = 'train'").drop("SPLIT")
    test = split.filter("SPLIT = 'test'").drop("SPLIT")
    assert train.intersect(test).count() == 0
    assert abs(train.count() / 4000 - 0.7) < 0.03
    other_layout = sampling.percent_split(reviews.repartition(11), 10).filter("SPLIT = 'train'").drop("SPLIT")
    assert train.exceptAll(other_layout).count() == 0
    some = sampling.percent_split(reviews, 10, max_users=3)
    assert {r[0] for r in some.select("USER_ID").distinct().collect()} == {0, 1, 2}


def test_quota(spark):
    stats = spark.createDataFrame([(1, 30, 20), (2, 10, 2), (3, 100, 5)], "USER_ID int, total_recipes int, total_reviews int")
    got = {r.USER_ID: (r.recipes, r.reviews, r.ratio_recipes, r.ratio_reviews) for r in sampling.user_quota(stats, 1, 1).collect()}
    assert got == {1: (21, 9, 0.7, 0.45), 2: (7, 2, 0.7, 1.0), 3: (70, 5, 0.7, 1.0)}


def test_quota_split_follows_the_ratios(spark):
    rows_ = spark.range(10_000).select(
        F.lit(1).alias("USER_ID"),
        F.col("id").alias("RECIPE_ID"),
        F.when(F.col("id") % 2 == 0, "recipes").otherwise("reviews").alias("type"),
    )
    quota = spark.createDataFrame([(1, 0.2, 0.9)], "USER_ID int, ratio_recipes double, ratio_reviews double")
    counts = {r.SPLIT: r["count"] for r in sampling.quota_split(quota, rows_).groupBy("SPLIT").count().collect()}
    assert abs(counts["train"] / 5000 - 0.2) < 0.03 and abs(counts["test"] / 5000 - 0.9) < 0.03


def test_held_out_and_exact_sample(spark):
    ratings = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 3)], "USER_ID int, RECIPE_ID int, RATING int")
    training = spark.createDataFrame([(1, 1, 5)], "USER_ID int, RECIPE_ID int, RATING int")
    assert rows(sampling.held_out(ratings, training)) == [(1, 2, 4)]
    assert sampling.exact_sample(spark.range(100), 7, ["id"]).count() == 7
    assert sampling.exact_sample(spark.range(5), 7, ["id"]).count() == 5
    assert sampling.exact_sample(spark.range(5), 0, ["id"]).count() == 0


def test_split_assets_dedupes(spark):
    split = spark.createDataFrame([(1, 100), (2, 100)], "USER_ID int, RECIPE_ID int")
    reviews = spark.createDataFrame([(100, 5, "b"), (100, 5, "a"), (100, 6, "c"), (200, 7, "d")], "RECIPE_ID int, ID int, t string")
    got = sampling.split_assets(split, {"reviews": (reviews, ["RECIPE_ID", "ID"])})["reviews"]
    assert rows(got) == [(100, 5, "a"), (100, 6, "c")]


def exchanged(df):
    """Columns the plan of ``df`` shuffles by hash, as one line per shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def placements(spark):
    from mirepoix.operators.placement import Placement

    shards = spark.createDataFrame([(1, 3)], "USER_ID int, __shards int")
    return [None, Placement(2), Placement(3, shards)]


def test_opened_lists_are_not_shuffled(spark, kitchen):
    from mirepoix.operators.placement import Placement

    idf = profiles.ingredient_idf(kitchen["recipes"], kitchen["ingredients"])
    profile = profiles.ingredient_profile(
        kitchen["training"], kitchen["ingredients"], idf, relative=True, place=Placement(2)
    )
    pairs = kitchen["training"].withColumn("RATING", F.lit(4))
    place = Placement(2)
    learnt = propagation.propagated_ratings(pairs, kitchen["ingredients"], place=place)
    predicted = propagation.propagation_predict(pairs, kitchen["ingredients"], learnt, place=place)
    scored = similarity.ingredient_similarity(pairs, profile, kitchen["ingredients"], place=place)
    # users with their ingredients as keys: before, every row of the profile went through such a shuffle
    for df in (profile, learnt, predicted, scored):
        assert not [e for e in exchanged(df) if "USER_ID" in e and "ID_INGREDIENT" in e]


def test_shards_of_a_heavy_user_change_nothing(spark, kitchen):
    """Pairs with nulls, a user and a recipe nobody knows, a pair twice and an ingredient listed twice."""
    schema = "USER_ID int, RECIPE_ID int, RATING int"
    training = spark.createDataFrame(
        [(1, 100, 2), (1, 101, 4), (1, 102, 5), (2, 100, 1), (None, 100, 3), (2, None, 3), (2, 103, None)], schema
    )
    test = spark.createDataFrame(
        [(1, 102, 4), (1, 103, 1), (1, 999, 1), (2, 101, 5), (2, 101, 5), (9, 102, 3), (None, 100, 2), (1, None, 2)],
        schema,
    )
    listed = kitchen["ingredients"].unionByName(
        spark.createDataFrame([(102, 7), (101, None)], "RECIPE_ID int, ID_INGREDIENT int")
    )
    idf = profiles.ingredient_idf(kitchen["recipes"], listed)
    seen = []
    for place in placements(spark):
        profile = profiles.ingredient_profile(training, listed, idf, place=place)
        learnt = propagation.propagated_ratings(training, listed, place=place)
        scored = similarity.ingredient_similarity(test, profile, listed, place=place)
        predicted = propagation.propagation_predict(test, listed, learnt, place=place)
        seen.append([rows(df.drop("__part")) for df in (profile, learnt, scored, predicted)])
    assert seen[0] == seen[1] == seen[2]
    profile, learnt, scored, predicted = seen[0]
    assert (1, 7, 4, round(4 * round(math.log10(10 / 4), 4), 4)) in profile
    assert [r[2] for r in learnt if r[:2] == (2, 9)] == [None]
    scores = {r[:2]: r[3:] for r in scored}
    assert scores[1, 999] == scores[1, None] == (0.0, 0.0)
    assert scores[9, 102] == scores[None, 100] == (None, None)
    # the pair that stands twice: products and sizes of both add up, as rows of one pair
    norm = math.sqrt(sum(r[2] ** 2 for r in profile if r[0] == 2))
    own = {r[1]: r[2] for r in profile if r[0] == 2}
    assert scores[2, 101][0] == pytest.approx(2 * own[7] / (norm * math.sqrt(2 * 1)))
    assert {r[:2] for r in predicted} == {(1, 102), (1, 103), (2, 101)}


def test_heavy_users_are_cut(spark):
    from mirepoix.operators.placement import place_users

    pairs = spark.createDataFrame([(1, r) for r in range(50)] + [(2, 1)], "USER_ID int, RECIPE_ID int")
    listed = spark.createDataFrame([(r, i) for r in range(50) for i in range(4)], "RECIPE_ID int, ID_INGREDIENT int")
    place = place_users(pairs, listed, task_rows=20, shard_rows=10)
    assert place.tasks == 11 and rows(place.heavy) == [(1, 5)]
    assert place_users(pairs, listed).heavy is None and place_users(pairs.limit(0), listed).tasks == 1


def test_ratings_come_with_the_pairs(spark):
    """Ratings of the reviews among the interactions, without building or joining these a second time."""
    from mirepoix.plans.content import ContentRecommender

    schema = "USER_ID int, RECIPE_ID int, RECIPE_TYPE string, RATING int"
    recipes = spark.createDataFrame([(r,) for r in range(6)], "RECIPE_ID int")
    ingredients = spark.createDataFrame([(r, i) for r in range(6) for i in range(r % 3 + 1)], "RECIPE_ID int, ID_INGREDIENT int")
    nutrition = spark.createDataFrame([(r, 2.0 + r, 1.0) for r in range(5)], "RECIPE_ID int, CALORIES double, FAT double")
    interactions = spark.createDataFrame(
        [
            *[(1, r, "recipes", 1) for r in (0, 1, 1)],
            *[(2, r, "recipes", 4) for r in (0, 3)],
            (1, 2, "review", 3), (1, 2, "review", 5), (1, 3, "fav", 5), (1, 0, "fav", 5), (1, 0, "review", 2),
            (2, 4, "review", None), (2, 3, None, 4), (2, 5, "review", 4), (None, 2, "review", 4), (3, 2, "review", 4),
            (None, 1, "recipes", 1), (None, None, "review", 2),
        ],
        schema,
    )
    ratings = (
        interactions.filter("RECIPE_TYPE = 'review'").groupBy("USER_ID", "RECIPE_ID").agg(F.max("RATING").alias("RATING"))
    )
    given, derived = (
        ContentRecommender(recipes, ingredients, nutrition, interactions, r, min_reviews=1, min_recipes=1)
        for r in (ratings, None)
    )
    assert rows(derived.test) == rows(given.test) == [(1, 0, 2), (1, 2, 5), (2, 4, None)]
    assert not exchanged(derived.test) and "Join" not in derived.test._jdf.queryExecution().executedPlan().toString()
    assert rows(derived.split) == rows(given.split)
    assert rows(derived.ingredient_similarity()) == rows(given.ingredient_similarity())
    assert rows(derived.similarities) == rows(given.similarities)


def test_small_idf_is_met_after_the_lists(spark, kitchen):
    """Lists without IDF give the profile that lists with IDF give, wherever users are, and shuffle narrower rows."""
    training = spark.createDataFrame(
        [(1, 100), (1, 101), (1, 100), (2, 100), (2, 102), (2, 999), (None, 100), (3, None)], "USER_ID int, RECIPE_ID int"
    )
    listed = spark.createDataFrame(
        [(100, 7), (100, 8), (101, 7), (102, 7), (102, 9), (102, None), (None, 7)], "RECIPE_ID int, ID_INGREDIENT int"
    )
    idf = profiles.ingredient_idf(kitchen["recipes"], listed.filter("ID_INGREDIENT > 7"))
    for place in placements(spark):
        for relative in (False, True):
            late = profiles.ingredient_profile(training, listed, idf, relative, place=place, small_idf=True)
            early = profiles.ingredient_profile(training, listed, idf, relative, place=place)
            assert rows(late) == rows(early) != [] and late.columns == early.columns
    late = profiles.ingredient_profile(training, listed, idf, place=placements(spark)[1], small_idf=True)
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(line for line in plan.split("\n") if "RepartitionByExpression" in line)
    assert "__l_0" in plan and "__l_1" not in plan, dealt


def test_large_idf_travels_with_the_lists(spark, monkeypatch):
    """Whatever the number of ingredients, the recommender gives the same profiles; repeats of rows change nothing."""
    from mirepoix.plans.content import ContentRecommender

    recipes = spark.createDataFrame([(r,) for r in range(6)], "RECIPE_ID int")
    once = [(r, i) for r in range(6) for i in range(r % 3 + 1)]
    nutrition = spark.createDataFrame([(r, 2.0 + r, 1.0) for r in range(5)], "RECIPE_ID int, CALORIES double, FAT double")
    interactions = spark.createDataFrame(
        [(u, r, kind, 1 + (u + r) % 5) for u in range(4) for r in range(6) for kind in ("recipes", "review")],
        "USER_ID int, RECIPE_ID int, RECIPE_TYPE string, RATING int",
    )

    def tables(listed):
        ingredients = spark.createDataFrame(listed, "RECIPE_ID int, ID_INGREDIENT int")
        c = ContentRecommender(recipes, ingredients, nutrition, interactions, min_reviews=1, min_recipes=1)
        assert rows(c.valid_ingredients) == sorted(((r, i) for r, i in once if r < 5), key=str)
        return [rows(df) for df in (c.idf, c.ingredient_profile(True), c.ingredient_similarity(), c.similarities)]

    small = tables(once * 3)
    monkeypatch.setattr(profiles, "MOST_SMALL_IDF", 0)
    assert tables(once) == small and all(small)


def test_join_of_many_pairs_is_dealt(spark):
    """A join that opens much is dealt to tasks by its size and not left to the number of files; same rows."""
    from mirepoix.operators import placement

    place = placement.Placement(placement.USERS_A_JOIN * placement.LEAST_JOINS)
    assert place.joins == placement.LEAST_JOINS and placement.Placement(place.tasks - placement.USERS_A_JOIN).joins is None
    pairs = spark.createDataFrame([(u, r) for u in range(9) for r in (1, 2, 3, None)], "USER_ID int, RECIPE_ID int")
    listed = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "RECIPE_ID int, ID_INGREDIENT int")
    for how in ("inner", "left"):
        args = "RECIPE_ID", "USER_ID", "ID_INGREDIENT", how
        many = placement.open_lists(pairs, listed, place, *args)
        assert many._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") < 3
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert rows(many) == rows(placement.open_lists(pairs, listed, placement.Placement(2), *args))
