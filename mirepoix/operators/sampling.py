"""Train and test splits, all repeatable: a row's side depends on its key and the seed only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.functions import column_min, hash_fraction
from mirepoix.operators.activity import group_count
from mirepoix.operators.ingest import dedupe, filter_by_keys
from mirepoix.operators.skew import salted_join


def eligible_users(
    stats: DataFrame, min_reviews: int, min_recipes: int, user: str = "USER_ID"
) -> DataFrame:
    """Users with enough reviews and enough own recipes."""
    return stats.filter(
        (F.col("total_reviews") >= min_reviews) & (F.col("total_recipes") >= min_recipes)
    ).select(user)


def type_split(
    stats: DataFrame,
    interactions: DataFrame,
    min_reviews: int = 10,
    min_recipes: int = 30,
    user: str = "USER_ID",
    kind: str = "type",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Interactions of eligible users with SPLIT = train for own recipes, test for reviews.

    ``heavy`` are the heavy users, if known.
    """
    users = eligible_users(stats, min_reviews, min_recipes, user)
    side = F.when(F.col(kind) == "recipes", "train").otherwise("test")
    return filter_by_keys(interactions, users, [user], heavy).withColumn("SPLIT", side)


def recipe_id_split(interactions: DataFrame, recipe: str = "RECIPE_ID", kind: str = "type") -> DataFrame:
    """Distinct recipe ids of each interaction type: train for own recipes, test for reviews."""
    side = F.when(F.col(kind) == "recipes", "train").otherwise("test")
    return interactions.select(side.alias("SPLIT"), recipe).distinct()


def user_quota(
    stats: DataFrame,
    min_reviews: int,
    min_recipes: int,
    training: float = 0.7,
    test: float = 0.3,
    user: str = "USER_ID",
) -> DataFrame:
    """How many recipes and reviews to draw per eligible user, and what share of each that is.

    Reviews are limited to the ``test`` share of the user's recipes, recipes to the ``training`` share.
    The products are decimal, so 0.7 of 30 is 21 and not one less.
    """
    train_share, test_share = Decimal(str(training)), Decimal(str(test))
    recipes, reviews = F.col("total_recipes"), F.col("total_reviews")
    by_ratio = F.lit(train_share / test_share).cast("decimal(18,12)") * recipes
    own = F.lit(train_share) * recipes
    quota = (
        stats.filter((reviews >= min_reviews) & (recipes >= min_recipes))
        .withColumn("reviews", F.floor(column_min(F.lit(test_share) * recipes, reviews)).cast("int"))
        .withColumn("recipes", F.floor(column_min(by_ratio, own)).cast("int"))
    )

    def share(part: str, whole: str):
        return F.round(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), 3)

    return quota.select(
        user,
        "total_recipes",
        "total_reviews",
        "recipes",
        "reviews",
        share("recipes", "total_recipes").alias("ratio_recipes"),
        share("reviews", "total_reviews").alias("ratio_reviews"),
    )


def quota_split(
    quota: DataFrame,
    interactions: DataFrame,
    seed: int = 0,
    portable: bool = False,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
    kind: str = "type",
) -> DataFrame:
    """Draw each user's own recipes (SPLIT = train) and reviews (test) at that user's ratios.

    The ratios are a joined column, so the plan does not grow with the number of users.
    """
    drawn = salted_join(interactions, quota.select(user, "ratio_recipes", "ratio_reviews"), [user])
    is_own = F.col(kind) == "recipes"
    ratio = F.when(is_own, F.col("ratio_recipes")).otherwise(F.col("ratio_reviews"))
    return (
        drawn.filter(hash_fraction(user, recipe, kind, seed=seed, portable=portable) < ratio)
        .withColumn("SPLIT", F.when(is_own, "train").otherwise("test"))
        .select(*interactions.columns, "SPLIT")
    )


def percent_split(
    reviews: DataFrame,
    min_reviews: int = 10,
    max_users: int | None = None,
    training: float = 0.7,
    seed: int = 0,
    portable: bool = False,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
) -> DataFrame:
    """Reviews of users with at least ``min_reviews`` of them, each on one side of a split.

    SPLIT = train with probability ``training``, else test. The side depends on the (user, recipe) pair,
    so repeats of a pair stay together and the two sides cannot overlap. ``max_users`` keeps the users
    with the lowest ids, as a sample of users; default all.
    """
    users = group_count(reviews, [user]).filter(F.col("N") >= min_reviews).select(user)
    if max_users is not None:
        users = users.orderBy(user).limit(max_users)
    drawn = hash_fraction(user, recipe, seed=seed, portable=portable) < training
    return filter_by_keys(reviews, users, [user]).withColumn("SPLIT", F.when(drawn, "train").otherwise("test"))


def rated_split(
    split: DataFrame,
    ratings: DataFrame,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
    rating: str = "RATING",
) -> DataFrame:
    """Give the pairs of a split their ratings. Both sides of the split share the one join."""
    return salted_join(ratings.select(user, recipe, rating), split, [user, recipe])


def held_out(
    ratings: DataFrame, training: DataFrame, user: str = "USER_ID", recipe: str = "RECIPE_ID"
) -> DataFrame:
    """Rated pairs that are not in ``training``, for users who have some training."""
    users = training.select(user).distinct()
    known = filter_by_keys(ratings, users, [user])
    test = known.select(user, recipe).subtract(training.select(user, recipe))
    return known.join(test, [user, recipe])


def exact_sample(
    df: DataFrame, n: int, keys: list[str], seed: int = 0, portable: bool = False
) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by key hash: a repeatable sample."""
    order = hash_fraction(*keys, seed=seed, portable=portable)
    return df.orderBy(order, *keys).limit(n)


def share(df: DataFrame, fraction: float, keys: list[str], seed: int = 0, portable: bool = False) -> DataFrame:
    """About ``fraction`` of the rows, chosen by key hash in the scan: no sort, whatever the size."""
    return df.filter(hash_fraction(*keys, seed=seed, portable=portable) < fraction)


def fraction_split(
    df: DataFrame, keys: list[str], training: float = 0.7, seed: int = 0, portable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Random two-way split by key hash: (training, rest)."""
    drawn = hash_fraction(*keys, seed=seed, portable=portable) < training
    return df.filter(drawn), df.filter(~drawn)


def split_assets(
    split: DataFrame,
    tables: dict[str, tuple[DataFrame, list[str]]],
    recipe: str = "RECIPE_ID",
) -> dict[str, DataFrame]:
    """The tables of one side of a split: rows of its recipes, one per the table's key."""
    recipes = split.select(recipe).distinct()
    return {
        name: dedupe(filter_by_keys(df, recipes, [recipe]), keys) for name, (df, keys) in tables.items()
    }
