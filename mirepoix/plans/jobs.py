"""End-to-end jobs over folders of delimited files, each leaving its results as files.

Inputs are pipe-separated, headed and untyped; ids and numbers that do not parse become null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.operators import activity, cooccurrence, difficulty, evaluation, ingest, sampling, similarity, text
from mirepoix.operators.propagation import propagation_predict
from mirepoix.plans.content import ContentRecommender
from mirepoix.plans.ratings import PropagationRecommender
from mirepoix.sources import (
    TAB,
    cast_except,
    read_columnar,
    read_delimited,
    stage,
    write_columnar,
    write_delimited,
    write_report,
)

KS = (5, 10, 30)
CUT = 3
RAW_CUT = 0.5


def _ints(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).try_cast("int").alias(c) for c in columns])


def ingest_job(spark: SparkSession, source: str, target: str) -> None:
    """Crawl tables to the dataset the recommenders read: ids named, sentinels and orphans gone."""

    def read(name: str) -> DataFrame:
        return read_delimited(spark, source, name)

    reviews, recipes = read("reviews"), read("recipes")
    interactions = ingest.unify_interactions(
        {"fav": read("favourites"), "recipes": read("publications"), "madeit": read("madeit"), "review": reviews},
        user_columns={"review": "AUTHOR_ID"},
    )
    known = ingest.drop_sentinel(read("ingredients"), "ID")
    write_delimited(interactions, target, "user-recipe")
    write_delimited(ingest.canonical_id(known, "ID_INGREDIENT"), target, "ingredients")
    write_delimited(ingest.canonical_id(recipes, "RECIPE_ID"), target, "recipes")
    write_delimited(ingest.reviews_with_recipe(reviews, recipes), target, "reviews")
    write_delimited(read("nutrition"), target, "nutrition")


def _ratings(spark: SparkSession, dataset: str) -> DataFrame:
    """Distinct USER_ID, RECIPE_ID, RATING of the reviews; ratings may have a fraction."""
    rows = read_delimited(spark, dataset, "reviews").withColumnRenamed("AUTHOR_ID", "USER_ID")
    pair = [F.col(c).try_cast("int").alias(c) for c in ("USER_ID", "RECIPE_ID")]
    return rows.select(*pair, F.col("RATING").try_cast("double").alias("RATING")).distinct()


def _ingredients(spark: SparkSession, dataset: str) -> DataFrame:
    return _ints(read_delimited(spark, dataset, "ingredients"), "RECIPE_ID", "ID_INGREDIENT")


def _reports(df: DataFrame, scores: Sequence[str], folder: str) -> None:
    """The four metric families of rounded ratings."""
    parts = evaluation.report_families(df, "USER_ID", "RECIPE_ID", "RATING", scores, CUT, KS)
    write_report(parts["regression"], folder, "regressionEvaluation")
    write_report(parts["binary"], folder, "binaryEvaluation")
    write_report(parts["ranking"], folder, "rankingEvaluation")
    write_report(evaluation.show_likelihood_ratio(parts["confusion"]), folder, "manualEvaluation")


def content_job(
    spark: SparkSession, dataset: str, output: str, min_reviews: int = 10, min_recipes: int = 30
) -> ContentRecommender:
    """Content-based recommender: statistics, IDF, profiles, similarities and their evaluation."""
    interactions = read_delimited(spark, dataset, "user-recipe")
    recommender = ContentRecommender(
        recipes=read_delimited(spark, dataset, "recipes").withColumn("RECIPE_ID", F.col("RECIPE_ID").try_cast("int")),
        ingredients=_ingredients(spark, dataset),
        nutrition=cast_except(read_delimited(spark, dataset, "nutrition"), ["RECIPE_ID"], "double", "int"),
        interactions=interactions.select(
            "RECIPE_TYPE",
            F.col("RECIPE_ID").try_cast("int").alias("RECIPE_ID"),
            F.col("USER_ID").try_cast("int").alias("USER_ID"),
        ),
        ratings=_ratings(spark, dataset),
        min_reviews=min_reviews,
        min_recipes=min_recipes,
    )
    for total, low in (("total_recipes", 30), ("total_reviews", 10)):
        curve = activity.activity_curve(recommender.stats, total, low, 100)
        write_delimited(curve, output, f"{total}_curve", TAB, single_file=True)
    write_delimited(recommender.stats, output, "stats")
    write_delimited(recommender.idf, output, "idf")
    write_delimited(recommender.nutrition_profile("avg"), output, "nutrition_profile_avg")
    write_delimited(recommender.nutrition_profile("sum"), output, "nutrition_profile_sum")
    write_delimited(recommender.ingredient_profile(relative=True), output, "ingredients_profile")

    path = write_columnar(recommender.similarities, f"{output}/similarities")
    table = read_columnar(spark, path)
    _reports(table, [rating for _, rating in similarity.SCORE_NAMES.values()], output)
    raw = evaluation.confusion_metrics(table, "RATING", list(similarity.SCORE_NAMES), CUT, RAW_CUT)
    write_report(evaluation.show_likelihood_ratio(raw), output, "rawScoreEvaluation")
    return recommender


def propagation_job(
    spark: SparkSession,
    dataset: str,
    output: str,
    min_reviews: int = 10,
    max_users: int | None = None,
    n_ratings: int | None = None,
    seed: int = 0,
) -> None:
    """Rating propagation: split, learn, predict and evaluate.

    ``max_users`` and ``n_ratings`` shrink the experiment to that many users and test ratings.
    """
    ingredients = _ingredients(spark, dataset)
    recommender = PropagationRecommender(
        _ratings(spark, dataset), ingredients, min_reviews, max_users, seed=seed
    )
    write_columnar(recommender.training, f"{output}/training")
    write_columnar(recommender.test, f"{output}/test")
    write_columnar(recommender.propagated, f"{output}/propagated")

    test = read_columnar(spark, f"{output}/test")
    if n_ratings is not None:
        test = sampling.exact_sample(test, n_ratings, ["USER_ID", "RECIPE_ID"], seed)
    predictions = propagation_predict(test, ingredients, read_columnar(spark, f"{output}/propagated"))
    write_columnar(predictions, f"{output}/prediction")
    _reports(read_columnar(spark, f"{output}/prediction"), ["propR"], output)


def graph_job(spark: SparkSession, folder: str, name: str, output: str, top_n: int) -> None:
    """Top-N ingredient rows, their undirected graph and their PMI graph, tab-separated."""
    raw = ingest.drop_sentinel(read_delimited(spark, folder, name), "ID_INGREDIENT")
    top = cooccurrence.top_n_ingredients(_ints(raw, "ID_RECIPE", "ID_INGREDIENT"), top_n)
    rows = stage(top, "top_rows")
    write_delimited(rows, output, "top_ingredients", TAB)
    write_delimited(cooccurrence.ingredient_graph(rows), output, "graph", TAB, header=False)
    pmi = cooccurrence.ingredient_pmi(rows)
    write_delimited(pmi, output, "pmi_graph", TAB, header=False)


def names_job(
    spark: SparkSession, folder: str, name: str, output: str, lemmas: DataFrame | None = None
) -> None:
    """Ingredient names from lines with LINE_NO, ID_INGREDIENT and TEXT_VALUE."""
    raw = read_delimited(spark, folder, name)
    lines = raw.select(
        F.col("LINE_NO").try_cast("bigint").alias("LINE_NO"),
        F.col("ID_INGREDIENT").try_cast("int").alias("ID_INGREDIENT"),
        "TEXT_VALUE",
    )
    write_delimited(text.ingredient_names(lines, lemmas), output, "ingredient_names")


def difficulty_job(
    spark: SparkSession, folder: str, sites: Sequence[str], output: str, seed: int = 42
) -> None:
    """Union of the sites' recipes, its feature statistics, and the accuracy of two classifiers.

    Each site is a sub-folder with a recipes table: ID, COOK_TIME, #INGREDIENTS, #STEPS, DIFFICULTY.
    """
    features = ("COOK_TIME", "#INGREDIENTS", "#STEPS")
    tables = {site: read_delimited(spark, f"{folder}/{site}", "recipes") for site in sites}
    union = difficulty.difficulty_dataset(
        {s: df.withColumn("SOURCE", F.lit(s)) for s, df in tables.items()}, ["SOURCE", "ID"], features
    )
    write_columnar(union, f"{output}/union")
    data = read_columnar(spark, f"{output}/union")
    write_report(activity.class_counts(data), output, "class_counts")
    pairs = [(features[2], features[1]), (features[2], features[0]), (features[0], features[1])]
    for statistic in ("corr", "cov"):
        write_report(activity.pair_statistics(data, pairs, statistic), output, statistic, digits=6)

    complete = data.dropna(subset=[*features, "DIFFICULTY"])
    labels = difficulty.fit_label_index(complete)
    training, test = sampling.fraction_split(complete, ["SOURCE", "ID"], 0.7, seed)
    predictions = {
        kind: difficulty.fit_classifier(training, labels, kind, features).transform(test)
        for kind in ("tree", "bayes")
    }
    write_report(difficulty.accuracy_table(predictions), output, "accuracy")
