"""From raw crawl tables to clean interactions: union, ids, sentinels, dedupe, validity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.skew import salted_join

# The interaction tags that count as "the user's recipes".
OWN_RECIPE_TYPES = ("recipes", "madeit", "fav")


def unify_interactions(
    sources: Mapping[str, DataFrame],
    user_columns: Mapping[str, str] | None = None,
    user: str = "USER_ID",
    recipe: str = "RECIPE_ID",
) -> DataFrame:
    """Stack the interaction tables into (RECIPE_TYPE, recipe, user), tagged by their key in ``sources``.

    ``user_columns`` names the user column of the sources that call it something else.
    """
    named = user_columns or {}
    parts = [
        df.select(
            F.lit(tag).alias("RECIPE_TYPE"), F.col(recipe), F.col(named.get(tag, user)).alias(user)
        )
        for tag, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def canonical_id(df: DataFrame, entity_id: str, raw: str = "ID") -> DataFrame:
    """Rename the generic id column to ``entity_id`` and put it first."""
    return df.select(F.col(raw).alias(entity_id), *[F.col(f"`{c}`") for c in df.columns if c != raw])


def drop_sentinel(df: DataFrame, id_column: str, sentinel: int = 0) -> DataFrame:
    """Drop rows whose id is the "unknown" sentinel, null, or no number at all."""
    return df.filter(F.col(id_column).try_cast("bigint") != sentinel)


def bad_id_audit(df: DataFrame, id_column: str, bad: Sequence[int] = (0, -1)) -> DataFrame:
    """How many rows carry each of the ``bad`` ids, and how many in all."""
    as_number = F.col(id_column).try_cast("bigint")
    return df.agg(
        F.count_if(as_number.isin(list(bad))).alias("n_bad"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def bucket_types(df: DataFrame, source: str = "RECIPE_TYPE", target: str = "type") -> DataFrame:
    """Two-way interaction type: the user's recipes, or reviews (any other tag, null included)."""
    own = F.col(source).isin(*OWN_RECIPE_TYPES)
    return df.withColumn(target, F.when(own, "recipes").otherwise("reviews")).drop(source)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by the remaining columns, so always the same one.

    Spark keeps only the leading row of a key in each map task (WindowGroupLimit), so a key with a
    third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    if not rest:
        return df.distinct()
    ranked = W.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("__rn", F.row_number().over(ranked)).filter("__rn <= 1").drop("__rn")


def filter_by_keys(
    df: DataFrame, keys: DataFrame, on: Sequence[str], heavy: DataFrame | None = None
) -> DataFrame:
    """Rows whose key is in ``keys``. Repeated keys do not multiply rows, heavy ones are spread."""
    return salted_join(df, keys, on, "left_semi", heavy=heavy)


def filter_dataset(
    keys: DataFrame, tables: Mapping[str, DataFrame], on: Sequence[str] = ("RECIPE_ID",)
) -> dict[str, DataFrame]:
    """Restrict every table to one key set."""
    return {name: filter_by_keys(df, keys, on) for name, df in tables.items()}


def valid_recipes(
    recipes: DataFrame,
    ingredients: DataFrame,
    nutrition: DataFrame,
    recipe: str = "RECIPE_ID",
    calories: str = "CALORIES",
) -> DataFrame:
    """Ids of recipes with an ingredient and a nutrition row, and no nutrition row of 0 calories.

    The nutrition side is folded to one row per recipe first, which answers both of its conditions.
    """
    has_zero = F.max((F.coalesce(F.col(calories).cast("double"), F.lit(1.0)) == 0.0).cast("int"))
    labelled = nutrition.groupBy(recipe).agg(has_zero.alias("__zero")).filter("__zero = 0").select(recipe)
    with_parts = ingredients.select(recipe).distinct()
    return (
        recipes.select(recipe)
        .distinct()
        .join(labelled, recipe, "left_semi")
        .join(with_parts, recipe, "left_semi")
    )


def reviews_with_recipe(
    reviews: DataFrame, recipes: DataFrame, recipe: str = "RECIPE_ID", raw: str = "ID"
) -> DataFrame:
    """Reviews whose recipe exists in the raw recipe table."""
    return filter_by_keys(reviews, recipes.select(F.col(raw).alias(recipe)), [recipe])


def clean_authored(
    df: DataFrame, recipe: str = "ID_RECIPE", author: str = "ID_AUTHOR"
) -> DataFrame:
    """Authored recipes with a known author, one row per (recipe, author)."""
    return dedupe(drop_sentinel(df, author), [recipe, author])


def exclusive_interactions(
    df: DataFrame, user: str = "USER_ID", recipe: str = "RECIPE_ID", kind: str = "type"
) -> DataFrame:
    """Interactions whose (user, recipe) pair is not both an own recipe and a review.

    One aggregate finds the pairs with both types; no self-join of the interactions.
    """
    both = (
        df.groupBy(user, recipe)
        .agg(
            F.max((F.col(kind) == "recipes").cast("int")).alias("__own"),
            F.max((F.col(kind) == "reviews").cast("int")).alias("__rev"),
        )
        .filter("__own = 1 AND __rev = 1")
        .select(user, recipe)
    )
    return salted_join(df, both, [user, recipe], "left_anti")
