"""What a user cooks: ingredient weights and nutrition, learnt from training interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators.activity import group_count
from mirepoix.operators.placement import Placement, open_lists, place_users
from mirepoix.operators.skew import salted_join

#: Ingredients whose IDF may be broadcast: some 30 MB.
MOST_SMALL_IDF = 1_000_000


def nutrient_columns(df: DataFrame, keys: Sequence[str] = ("RECIPE_ID", "USER_ID")) -> list[str]:
    """Every column that is not a key."""
    return [c for c in df.columns if c not in set(keys)]


def ingredient_idf(
    recipes: DataFrame, ingredients: DataFrame, ingredient: str = "ID_INGREDIENT"
) -> DataFrame:
    """IDF per ingredient: log10(recipe rows / ingredient rows), to 4 decimals.

    Rows are counted, not distinct recipes, so deduplicate first if the tables hold repeats.
    """
    n_recipes = recipes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return group_count(ingredients, [ingredient], "__n").select(
        ingredient, F.round(F.log10(n_recipes / F.col("__n")), 4).alias("IDF")
    )


def user_nutrition_rows(
    interactions: DataFrame,
    nutrition: DataFrame,
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Nutrition of every recipe a user has: (user, recipe, nutrients). ``heavy`` are the heavy recipes, if known."""
    pairs = interactions.select(user, recipe)
    return salted_join(pairs, nutrition, [recipe], heavy=heavy).select(user, recipe, *nutrient_columns(nutrition))


def nutrition_profile(
    interactions: DataFrame,
    nutrition: DataFrame,
    how: str = "avg",
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Per-user ``avg`` (3 decimals) or ``sum`` of every nutrient, as one row of columns."""
    rows = user_nutrition_rows(interactions, nutrition, recipe, user, heavy)
    if how == "avg":
        folded = [F.round(F.avg(c), 3).alias(c) for c in nutrient_columns(nutrition)]
    elif how == "sum":
        folded = [F.sum(c).alias(c) for c in nutrient_columns(nutrition)]
    else:
        raise ValueError(f"unknown profile {how!r}")
    return rows.groupBy(user).agg(*folded)


def weighted_ingredients(
    ingredients: DataFrame, idf: DataFrame, recipe: str = "RECIPE_ID", ingredient: str = "ID_INGREDIENT"
) -> DataFrame:
    """The ingredient rows with their IDF; rows without one drop out."""
    return salted_join(ingredients.select(recipe, ingredient), idf, [ingredient], spread=[recipe])


def ingredient_profile(
    interactions: DataFrame,
    ingredients: DataFrame,
    idf: DataFrame,
    relative: bool = False,
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    ingredient: str = "ID_INGREDIENT",
    place: Placement | None = None,
    lists: DataFrame | None = None,
    heavy: DataFrame | None = None,
    small_idf: bool = False,
) -> DataFrame:
    """How often an ingredient occurs over the user's recipes, plain and IDF-weighted (4 decimals).

    The IDF is attached to the ingredient rows before they fan out to users, the smaller of the two
    places it could be joined. ``relative`` adds the frequency per recipe of the user. With ``place`` the rows stay
    where it deals them, with the shard of a heavy user as a column. ``lists`` are the ``recipe_lists`` of
    ``weighted_ingredients``, ``heavy`` the heavy recipes of ``interactions``.

    ``small_idf`` says that ``idf`` has one row per ingredient and at most ``MOST_SMALL_IDF`` rows: then it is broadcast
    to the finished counts, and lists travel without it (``lists`` are those of ``ingredients``).
    """
    listed = ingredients.select(recipe, ingredient)
    if not small_idf:
        listed = weighted_ingredients(ingredients, idf, recipe, ingredient)
    pairs = interactions.select(user, recipe)
    dealt = place or place_users(pairs, ingredients, recipe, user)
    if relative:
        # on the pairs, of which there are far fewer than rows of the profile
        pairs = salted_join(pairs, group_count(pairs, [user], "__n"), [user], spread=[recipe])
    rows = open_lists(pairs, listed, dealt, recipe, user, ingredient, lists=lists, heavy=heavy)
    counted = [F.count(F.lit(1)).alias("ABSOLUTE_FREQUENCY")]
    if not small_idf:
        counted.append(F.max("IDF").alias("__idf"))
    if relative:
        counted.append(F.max("__n").alias("__n"))
    profile = rows.groupBy(*dealt.keys(user), ingredient).agg(*counted)
    if small_idf:
        profile = profile.join(F.broadcast(idf.select(ingredient, F.col("IDF").alias("__idf"))), ingredient)
    columns = [
        *(dealt.keys(user) if place else [user]),
        ingredient,
        "ABSOLUTE_FREQUENCY",
        F.round(F.col("ABSOLUTE_FREQUENCY") * F.col("__idf"), 4).alias("N_IDF"),
    ]
    if relative:
        columns.append((F.col("ABSOLUTE_FREQUENCY") / F.col("__n")).alias("RELATIVE_FREQUENCY"))
    return profile.select(*columns)
