"""Counts, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators.ingest import dedupe, drop_sentinel
from mirepoix.operators.skew import salted_join


def group_count(df: DataFrame, keys: Sequence[str], name: str = "N") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def graph_counts(df: DataFrame, recipe: str = "ID_RECIPE", ingredient: str = "ID_INGREDIENT") -> DataFrame:
    """Number of distinct recipes and distinct ingredients.

    Two separate distinct counts: each shuffles its own column only, where one aggregate over both
    would first expand every row to two.
    """
    recipes = df.agg(F.count_distinct(F.col(recipe)).alias("n")).scalar()
    return df.agg(F.count_distinct(F.col(ingredient)).alias("n_ingredients")).select(
        recipes.alias("n_recipes"), "n_ingredients"
    )


def user_stats(
    df: DataFrame, user: str = "USER_ID", kind: str = "type", weight: str | None = None
) -> DataFrame:
    """Own recipes and reviews per user; 0 where a user has none.

    ``weight`` names a column that counts the copies a row stands for.
    """
    pivoted = df.groupBy(user).pivot(kind, ["reviews", "recipes"])
    counts = pivoted.count() if weight is None else pivoted.agg(F.sum(weight))
    return counts.select(
        user,
        F.coalesce(F.col("recipes"), F.lit(0)).alias("total_recipes"),
        F.coalesce(F.col("reviews"), F.lit(0)).alias("total_reviews"),
    )


def pivot_sum(
    df: DataFrame, key: str, pivot: str, value: str, values: Sequence[object] | None = None
) -> DataFrame:
    """One column per pivot value holding the summed ``value``, 0 where there is none.

    Without ``values`` Spark runs a job to find them.
    """
    grouped = df.groupBy(key)
    wide = grouped.pivot(pivot, list(values)) if values is not None else grouped.pivot(pivot)
    return wide.agg(F.sum(value)).fillna(0)


def activity_curve(df: DataFrame, total: str, low: int, high: int) -> DataFrame:
    """Number of rows with ``total`` at or above each threshold in ``low..high``.

    One pass: a histogram of at most ``high - low + 1`` values, each of which then counts for all the
    thresholds below it.
    """
    capped = F.least(F.col(total), F.lit(high)).cast("int")
    histogram = df.filter(F.col(total) >= low).groupBy(capped.alias("__level")).count()
    reached = (
        histogram.select(
            F.explode(F.sequence(F.lit(low), F.col("__level"))).alias("threshold"), "count"
        )
        .groupBy("threshold")
        .agg(F.sum("count").alias("n_users"))
    )
    thresholds = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("threshold"))
    return thresholds.join(reached, "threshold", "left").select(
        "threshold", F.coalesce(F.col("n_users"), F.lit(0)).alias("n_users")
    )


def class_counts(
    df: DataFrame,
    source: str = "SOURCE",
    label: str = "DIFFICULTY",
    classes: Sequence[str] = ("hard", "medium", "easy"),
) -> DataFrame:
    """Rows per source, in all and per class."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(label) == c).alias(c) for c in classes],
    )


def role_activity(
    df: DataFrame,
    role: str,
    unique_pairs: bool,
    user: str = "ID_USER",
    recipe: str = "ID_RECIPE",
    role_column: str = "ROLE",
) -> DataFrame:
    """Rows of one role with the user's row count in that role.

    ``unique_pairs`` counts and keeps each (recipe, user) once: so for authors, not for reviewers.
    The count is an aggregate joined back with salt; a window would gather a user in one task.
    """
    rows = drop_sentinel(df, user).filter(F.col(role_column) == role)
    if unique_pairs:
        rows = dedupe(rows, [recipe, user])
    counts = group_count(rows, [user], "RECIPE_COUNT")
    return salted_join(rows, counts, [user]).select(*df.columns, "RECIPE_COUNT")


def busiest_users(
    df: DataFrame,
    role: str,
    unique_pairs: bool,
    user: str = "ID_USER",
    recipe: str = "ID_RECIPE",
    role_column: str = "ROLE",
) -> DataFrame:
    """One row per user of a role: (user, role, RECIPE_COUNT)."""
    rows = drop_sentinel(df, user).filter(F.col(role_column) == role)
    if unique_pairs:
        rows = rows.select(user, recipe).distinct()
    return group_count(rows, [user], "RECIPE_COUNT").select(
        user, F.lit(role).alias(role_column), "RECIPE_COUNT"
    )


def active_users(
    recipes: DataFrame, reviews: DataFrame, more_than: int = 30, user: str = "USER_ID"
) -> DataFrame:
    """Users with more than ``more_than`` recipes and more than ``more_than`` reviews."""
    busy_cooks = group_count(recipes, [user], "n_recipes").filter(F.col("n_recipes") > more_than)
    busy_critics = group_count(reviews, [user], "n_reviews").filter(F.col("n_reviews") > more_than)
    return busy_cooks.join(busy_critics, user)


def pair_statistics(df: DataFrame, pairs: Sequence[tuple[str, str]], statistic: str) -> DataFrame:
    """Pearson correlation (``corr``) or sample covariance (``cov``) of column pairs, in one pass.

    One output column per pair, named ``<statistic>_<a>_<b>``.
    """
    measure = {"corr": F.corr, "cov": F.covar_samp}[statistic]
    return df.agg(
        *[measure(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{statistic}_{a}_{b}") for a, b in pairs]
    )
