"""Ratings that travel from recipes to their ingredients and on to other recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.functions import rating_round, steady
from mirepoix.operators.placement import ASKED, HITS, Placement, meet, open_lists, place_users


def propagated_ratings(
    training: DataFrame,
    ingredients: DataFrame,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
    ingredient: str = "ID_INGREDIENT",
    rating: str = "RATING",
    place: Placement | None = None,
) -> DataFrame:
    """Learn: mean rating a user gave to the recipes with an ingredient.

    Ratings are averaged as decimals of six places, so the mean is the same in whatever order they are added.
    With ``place`` the rows stay where it deals them, with the shard of a heavy user as a column.
    """
    dealt = place or place_users(training, ingredients, recipe, user)
    pairs = training.select(user, recipe, F.col(rating).cast("decimal(18,6)").alias(rating))
    rated = open_lists(pairs, ingredients.select(recipe, ingredient), dealt, recipe, user, ingredient)
    learnt = rated.groupBy(*dealt.keys(user), ingredient).agg(F.avg(rating).cast("double").alias("INGR_RATING"))
    return learnt.select(*(dealt.keys(user) if place else [user]), ingredient, "INGR_RATING")


def propagation_predict(
    test: DataFrame,
    ingredients: DataFrame,
    propagated: DataFrame,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
    ingredient: str = "ID_INGREDIENT",
    mode: str = "upward",
    place: Placement | None = None,
) -> DataFrame:
    """Predict: mean of the user's known ingredient ratings over a recipe's ingredients.

    ``test`` holds distinct pairs and may carry their rating. Pairs of which no ingredient is known
    drop out. Test columns ride along as grouping keys, which saves joining them back. ``place`` is where
    ``propagated`` has been dealt: then it is not shuffled again.
    """
    dealt = place or place_users(test, ingredients, recipe, user)
    learnt = dealt.tag(propagated, user, ingredient)
    if place is None:
        learnt = dealt.deal(learnt, user)
    listed = open_lists(test, ingredients.select(recipe, ingredient), dealt, recipe, user, ingredient)
    known = meet(learnt, listed, dealt.keys(user), ingredient, ["INGR_RATING"])
    known = known.filter(F.col(ASKED) & (F.col(HITS) > 0))
    mean = F.try_divide(F.sum("__sum_INGR_RATING"), F.sum("__n_INGR_RATING"))
    predicted = known.groupBy(*test.columns).agg(steady(mean).alias("predicted_rating"))
    return predicted.withColumn("propR", rating_round(F.col("predicted_rating"), mode))
