"""Recipe tables derived from the TPC-H-like test tables.

Recipe = part, ingredient = supplier, user = customer, rating = binned quantity; for the ingredient
graph a basket is an order. Supplier 0 plays the "unknown ingredient". Every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.operators.ingest import drop_sentinel

NUTRIENTS = ("CALORIES", "FAT", "PROTEIN", "FIBER", "SUGARS", "SODIUM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_ID, RECIPE_ID, RECIPE_TYPE, RATING, ID: one row per order line."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    kind = (
        F.when(F.col("l_returnflag") == "N", "review")
        .when(F.col("l_returnflag") == "A", "recipes")
        .when(F.col("l_linestatus") == "F", "fav")
        .otherwise("madeit")
    )
    # before the join, so that narrower rows are shuffled
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("RECIPE_ID"),
        kind.alias("RECIPE_TYPE"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("RATING"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ID"),
    )
    return lines.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("USER_ID"), "RECIPE_ID", "RECIPE_TYPE", "RATING", "ID"
    )


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("RECIPE_ID"), F.col("p_name").alias("NAME"))


def _ingredient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("RECIPE_ID"), F.col("l_suppkey").alias("ID_INGREDIENT")
    )


def raw_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECIPE_ID, ID_INGREDIENT with the sentinel ingredient 0 still in."""
    return _ingredient_lines(spark, sf_dir).distinct()


def ingredient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ingredients`` with their repeats, for readers that remove them anyway."""
    return drop_sentinel(_ingredient_lines(spark, sf_dir), "ID_INGREDIENT")


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_sentinel(raw_ingredients(spark, sf_dir), "ID_INGREDIENT")


def nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers as doubles. The largest size carries no label, one brand declares 0 calories."""
    key = F.col("p_partkey")
    calories = F.when(F.col("p_brand") == "Brand#7", 0).otherwise(F.col("p_size"))
    values = {
        "CALORIES": calories,
        "FAT": key % 17,
        "PROTEIN": key % 23,
        "FIBER": key % 7,
        "SUGARS": key % 11,
        "SODIUM": key % 31,
    }
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_size") < 50)
        .select(key.alias("RECIPE_ID"), *[v.cast("double").alias(n) for n, v in values.items()])
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_ID, RECIPE_ID, RATING: a user's best rating of a recipe."""
    return (
        interactions(spark, sf_dir)
        .filter("RECIPE_TYPE = 'review'")
        .groupBy("USER_ID", "RECIPE_ID")
        .agg(F.max("RATING").alias("RATING"))
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID_RECIPE, ID_INGREDIENT for the ingredient graph, repeats included."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ID_RECIPE"), F.col("l_suppkey").alias("ID_INGREDIENT")
    )
    return drop_sentinel(lines, "ID_INGREDIENT")


def ingredient_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINE_NO, ID_INGREDIENT, TEXT_VALUE: "11 cups small ring, economy"."""
    text = F.concat(
        F.col("p_size").cast("string"), F.lit(" cups "), F.col("p_name"), F.lit(", "), F.lower("p_type")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("LINE_NO"),
        (F.col("p_partkey") % 100).alias("ID_INGREDIENT"),
        text.alias("TEXT_VALUE"),
    )


def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID, SOURCE, COOK_TIME, N_INGREDIENTS, N_STEPS, DIFFICULTY: one row per order.

    Two plain aggregates instead of one with a distinct count, which would expand every row.
    """
    per_part = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    orders = per_part.groupBy("l_orderkey").agg(
        F.sum("q").alias("Q"),
        F.count(F.lit(1)).cast("int").alias("N_INGREDIENTS"),
        F.sum("n").cast("int").alias("N_STEPS"),
    )
    label = F.when(F.col("Q") < 60, "easy").when(F.col("Q") < 140, "medium").otherwise("hard")
    return orders.select(
        F.col("l_orderkey").alias("ID"),
        (F.col("l_orderkey") % 4).alias("SOURCE"),
        F.when(F.col("l_orderkey") % 20 == 0, 0).otherwise(F.col("Q")).cast("int").alias("COOK_TIME"),
        "N_INGREDIENTS",
        "N_STEPS",
        label.alias("DIFFICULTY"),
    )


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID_USER, ID_RECIPE, ROLE."""
    return interactions(spark, sf_dir).select(
        F.col("USER_ID").alias("ID_USER"),
        F.col("RECIPE_ID").alias("ID_RECIPE"),
        F.when(F.col("RECIPE_TYPE") == "review", "reviewer").otherwise("author").alias("ROLE"),
    )
