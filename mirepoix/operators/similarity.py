"""Content similarity of (user, recipe) pairs: all pairs of a test set in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import cosine, l2_norm, minmax_scale, rating_round, steady
from mirepoix.operators.placement import ASKED, HITS, Placement, meet, open_lists, place_users
from mirepoix.operators.profiles import nutrient_columns
from mirepoix.operators.skew import heavy_keys, salted_join

# Raw score -> (scaled score, rounded prediction) of the similarity table.
SCORE_NAMES = {
    "NUTRITION_SIMILARITY": ("SCALED_NUTRITION_SIMILARITY", "avgN"),
    "ING_ABSOLUTE_SIMILARITY": ("SCALED_ING_ABSOLUTE_SIMILARITY", "absI"),
    "IDF_SIMILARITY": ("SCALED_IDF_SIMILARITY", "weightI"),
    "ABS_NUT_SIMILARITY": ("SCALED_ABS_NUT_SIMILARITY", "absN"),
    "IDF_NUT_SIMILARITY": ("SCALED_IDF_NUT_SIMILARITY", "weightN"),
}


def nutrition_similarity(
    pairs: DataFrame,
    profile: DataFrame,
    nutrition: DataFrame,
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    name: str = "NUTRITION_SIMILARITY",
    heavy: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``pairs`` plus the cosine of the user's nutrition profile and the recipe's nutrition.

    0 for a recipe without nutrition, null where either vector has no length or the user no profile.
    Vector lengths are computed once per user and per recipe, not per pair. ``heavy`` are the heavy recipes and the
    heavy users, for when ``pairs`` would have to be computed again to count them.
    """
    nutrients = nutrient_columns(nutrition)
    theirs = [F.col(f"__u_{c}") for c in nutrients]
    its = [F.col(f"__r_{c}") for c in nutrients]

    def vectors(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(
            key,
            *[F.col(c).alias(f"__{tag}_{c}") for c in nutrients],
            l2_norm([F.col(c) for c in nutrients]).alias(f"__{tag}_norm"),
        )

    heavy_recipes, heavy_users = heavy or (heavy_keys(pairs.select(key), [key]) for key in (recipe, user))
    wide = salted_join(
        pairs, vectors(nutrition, recipe, "r"), [recipe], "left", spread=[user], heavy=heavy_recipes
    )
    wide = salted_join(
        wide, vectors(profile, user, "u"), [user], "left", spread=[recipe], heavy=heavy_users
    )
    score = cosine(theirs, its, F.col("__u_norm"), F.col("__r_norm"))
    score = F.when(F.col("__r_norm").isNull(), F.lit(0.0)).otherwise(score)
    return wide.select(*pairs.columns, steady(score).alias(name))


def ingredient_similarity(
    pairs: DataFrame,
    profile: DataFrame,
    ingredients: DataFrame,
    weights: Sequence[tuple[str, str]] = (
        ("ABSOLUTE_FREQUENCY", "ING_ABSOLUTE_SIMILARITY"),
        ("N_IDF", "IDF_SIMILARITY"),
    ),
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    ingredient: str = "ID_INGREDIENT",
    place: Placement | None = None,
    lists: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``pairs`` (distinct) plus, per weight, the cosine of the profile and the recipe's ingredients.

    A recipe is the vector with 1 at each of its ingredients, so the product is the sum of the user's
    weights over them. 0 for a recipe without ingredients, null for a user whose profile has no length.
    ``place`` is where ``profile`` has been dealt: then it is not shuffled again. ``lists`` are the ``recipe_lists`` of
    ``ingredients`` (those without ingredient may be missing), ``heavy`` the heavy recipes of ``pairs``.
    """
    dealt = place or place_users(pairs, ingredients, recipe, user)
    keys = dealt.keys(user)
    learnt = dealt.tag(profile, user, ingredient)
    if place is None:
        learnt = dealt.deal(learnt, user)
    listed = open_lists(
        pairs, ingredients.select(recipe, ingredient), dealt, recipe, user, ingredient, "left", lists, heavy
    )
    met = meet(learnt, listed, keys, ingredient, [w for w, _ in weights])

    def square(weight: str):
        return F.when(~F.col(ASKED), F.col(weight).cast("double") * F.col(weight).cast("double"))

    # a user's own row, with the lengths, comes before the user's pairs
    products = met.groupBy(ASKED, *pairs.columns).agg(
        F.sum(F.when(F.col(ingredient).isNotNull(), F.greatest(F.col(HITS), F.lit(1)))).alias("__size"),
        *[F.coalesce(F.sum(f"__sum_{w}"), F.lit(0)).cast("double").alias(f"__dot_{w}") for w, _ in weights],
        *[F.sqrt(F.sum(square(w))).alias(f"__own_{w}") for w, _ in weights],
    )
    so_far = W.partitionBy(user).orderBy(ASKED).rowsBetween(W.unboundedPreceding, W.currentRow)
    norms = [
        F.when(F.col(user).isNotNull(), F.max(f"__own_{w}").over(so_far)).alias(f"__norm_{w}") for w, _ in weights
    ]
    size = F.coalesce("__size", F.lit(0)).alias("__size")
    scored = products.select(
        ASKED, *pairs.columns, size, *[f"__dot_{w}" for w, _ in weights], *norms
    ).filter(ASKED)

    def score(weight: str):
        lengths = F.col(f"__norm_{weight}") * F.sqrt(F.col("__size").cast("double"))
        return F.when(F.col("__size") == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.col(f"__dot_{weight}"), lengths)
        )

    return scored.select(*pairs.columns, *[steady(score(w)).alias(name) for w, name in weights])


def blend(df: DataFrame) -> DataFrame:
    """Add the even blends of each ingredient score with the nutrition score."""
    nutrition = F.col("NUTRITION_SIMILARITY")
    return df.withColumns(
        {
            "ABS_NUT_SIMILARITY": (F.col("ING_ABSOLUTE_SIMILARITY") + nutrition) / 2,
            "IDF_NUT_SIMILARITY": (F.col("IDF_SIMILARITY") + nutrition) / 2,
        }
    )


def scaled_similarity(
    df: DataFrame,
    names: dict[str, tuple[str, str]] = SCORE_NAMES,
    digits: int | None = None,
    mode: str = "upward",
) -> DataFrame:
    """Add the 0-5 scaled value and the rounded rating of each score.

    ``digits`` also rounds the scaled values, before ratings are derived from them.
    """
    scaled = {big: minmax_scale(F.col(raw)) for raw, (big, _) in names.items()}
    if digits is not None:
        scaled = {name: F.round(value, digits) for name, value in scaled.items()}
    ratings = {
        small: rating_round(steady(F.col(big), 9), mode) for big, small in names.values()
    }
    return df.withColumns(scaled).withColumns(ratings)


def similarity_table(
    test: DataFrame,
    nutrition: DataFrame,
    ingredients: DataFrame,
    nutrition_profile: DataFrame,
    ingredient_profile: DataFrame,
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    place: Placement | None = None,
    lists: DataFrame | None = None,
    heavy: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The five similarities of each rated test pair, raw, scaled to 0-5 and rounded to ratings.

    ``place`` is where ``ingredient_profile`` has been dealt, ``lists`` the ``recipe_lists`` of ``ingredients``, ``heavy``
    the heavy recipes and heavy users of ``test``.
    """
    heavy = heavy or tuple(heavy_keys(test.select(key), [key]) for key in (recipe, user))
    scored = ingredient_similarity(
        test, ingredient_profile, ingredients, recipe=recipe, user=user, place=place, lists=lists, heavy=heavy[0]
    )
    scored = nutrition_similarity(scored, nutrition_profile, nutrition, recipe=recipe, user=user, heavy=heavy)
    full = scaled_similarity(blend(scored))
    order = [*test.columns, *SCORE_NAMES, *[b for b, _ in SCORE_NAMES.values()], *[s for _, s in SCORE_NAMES.values()]]
    return full.select(*order)


def dense_cosine(
    df: DataFrame, left: Sequence[str], right: Sequence[str], name: str = "cosine"
) -> DataFrame:
    """Cosine of two lists of columns of the same row."""
    return df.withColumn(name, cosine([F.col(c) for c in left], [F.col(c) for c in right]))

