"""The ingredient graph: which ingredients meet in a recipe, how often, and is that more than chance.

Pairs are generated inside recipes, so the size of a recipe matters, not the number of its rows:
repeats are removed first. Pairs are never written out or shuffled as such; the map task that produces
them adds them up, and only edge counts move. Recipes of more than ``block_rows`` ingredients are cut
into blocks that different tasks pair up. Rows and pairs are counted first, which gives the number of tasks: none
holds more of them because the tables are larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators.placement import TASK_ROWS, tasks_for

#: Ingredients of a recipe that are paired in one task; larger recipes are cut into blocks.
BLOCK_ROWS = 1000


def top_n_ingredients(
    df: DataFrame, n: int, recipe: str = "ID_RECIPE", ingredient: str = "ID_INGREDIENT"
) -> DataFrame:
    """Distinct (recipe, ingredient) rows of the ``n`` most frequent ingredients, ties by id."""
    rows = df.select(recipe, ingredient).distinct()
    top = (
        rows.groupBy(ingredient)
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), ingredient)
        .limit(n)
        .select(ingredient)
    )
    return rows.join(top, ingredient, "left_semi").select(recipe, ingredient)


def _distinct_rows(df: DataFrame, recipe: str, ingredient: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct (recipe, ingredient) rows, dealt to as many tasks as the rows need."""
    rows = df.select(recipe, ingredient)
    return rows.repartition(tasks_for(rows.count(), task_rows), recipe, ingredient).distinct()


def _pairs_across_blocks(
    rows: DataFrame, recipe: str, ingredient: str, block_rows: int, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Pairs of each recipe, which is cut into blocks; every two blocks are joined on their own."""
    n = F.col("n").cast("double")
    n_pairs = rows.groupBy(recipe).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0]
    tasks = tasks_for(n_pairs, task_rows)
    sizes = rows.groupBy(recipe).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__blocks"))
    block = F.pmod(F.xxhash64(ingredient), F.col("__blocks")).cast("int")
    placed = rows.join(sizes, recipe).withColumn("__block", block)
    first = placed.select(
        recipe,
        F.col(ingredient).alias("__a"),
        F.col("__block").alias("__i"),
        F.explode(F.sequence(F.col("__block"), (F.col("__blocks") - 1).cast("int"))).alias("__j"),
    )
    second = placed.select(
        recipe,
        F.col(ingredient).alias("__b"),
        F.explode(F.sequence(F.lit(0), F.col("__block"))).alias("__i"),
        F.col("__block").alias("__j"),
    )
    first, second = (side.repartition(tasks, recipe, "__i", "__j") for side in (first, second))
    met = first.join(second.hint("merge"), [recipe, "__i", "__j"]).filter("__i < __j OR __a < __b")
    return met.select(
        F.least("__a", "__b").alias("ORIGIN"), F.greatest("__a", "__b").alias("DESTINATION")
    )


def cooccurrence_counts(
    df: DataFrame,
    recipe: str = "ID_RECIPE",
    ingredient: str = "ID_INGREDIENT",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Undirected edges ORIGIN < DESTINATION with N_RECIPES, the recipes that hold both."""
    rows = _distinct_rows(df, recipe, ingredient)
    pairs = _pairs_across_blocks(rows, recipe, ingredient, block_rows)
    return pairs.groupBy("ORIGIN", "DESTINATION").agg(F.count(F.lit(1)).alias("N_RECIPES"))


def directed_edges(counts: DataFrame) -> DataFrame:
    """Both directions of undirected edges, mirrored after counting (half the pairs of a ≠ join)."""
    there = F.struct(F.col("ORIGIN"), F.col("DESTINATION"))
    back = F.struct(F.col("DESTINATION").alias("ORIGIN"), F.col("ORIGIN").alias("DESTINATION"))
    return counts.select(F.explode(F.array(there, back)).alias("e"), "N_RECIPES").select(
        "e.ORIGIN", "e.DESTINATION", "N_RECIPES"
    )


def ingredient_graph(df: DataFrame, block_rows: int = BLOCK_ROWS, **names: str) -> DataFrame:
    """Distinct undirected edges, ORIGIN < DESTINATION."""
    return cooccurrence_counts(df, block_rows=block_rows, **names).select("ORIGIN", "DESTINATION")


def _n_recipes(df: DataFrame, recipe: str):
    return df.agg(F.count_distinct(F.col(recipe)).alias("n")).scalar()


def pair_probability(
    df: DataFrame,
    recipe: str = "ID_RECIPE",
    ingredient: str = "ID_INGREDIENT",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Share of the recipes that hold both ends of an edge: P(ORIGIN,DESTINATION)."""
    counts = cooccurrence_counts(df, recipe, ingredient, block_rows)
    joint = F.col("N_RECIPES") / _n_recipes(df, recipe)
    return counts.select("ORIGIN", "DESTINATION", joint.alias("P(ORIGIN,DESTINATION)"))


def ingredient_pmi(
    df: DataFrame,
    recipe: str = "ID_RECIPE",
    ingredient: str = "ID_INGREDIENT",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Edges with P, 1/P and pointwise mutual information, log2(P(o,d) / (P(o) P(d)))."""
    n_recipes = _n_recipes(df, recipe)
    single = (
        _distinct_rows(df, recipe, ingredient)
        .groupBy(ingredient)
        .agg((F.count(F.lit(1)) / n_recipes).alias("__p"))
    )

    def end(name: str, p: str) -> DataFrame:
        return single.select(F.col(ingredient).alias(name), F.col("__p").alias(p))

    joint = F.col("P(ORIGIN,DESTINATION)")
    return (
        pair_probability(df, recipe, ingredient, block_rows)
        .join(end("ORIGIN", "__po"), "ORIGIN")
        .join(end("DESTINATION", "__pd"), "DESTINATION")
        .select(
            "ORIGIN",
            "DESTINATION",
            joint,
            (F.lit(1.0) / joint).alias("1/P(ORIGIN,DESTINATION)"),
            F.log2(joint / (F.col("__po") * F.col("__pd"))).alias("PMI"),
        )
    )
