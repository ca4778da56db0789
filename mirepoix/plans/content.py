"""The content-based recommender from clean tables to the similarity table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.operators import ingest, profiles, sampling, similarity
from mirepoix.operators.activity import group_count, user_stats
from mirepoix.operators.placement import Placement, list_rows, place_users, recipe_lists
from mirepoix.operators.skew import heavy_keys
from mirepoix.sources import stage


@dataclass
class ContentRecommender:
    """Stages of the recommender, each a DataFrame built on demand.

    ``interactions`` needs USER_ID, RECIPE_ID, RECIPE_TYPE and ``ratings`` USER_ID, RECIPE_ID, RATING. Without ``ratings``
    the interactions need RATING, and a pair's rating is the best one of its interactions of type "review".
    With ``staged`` the tables that several later stages read are written to the shared folder once.
    """

    recipes: DataFrame
    ingredients: DataFrame
    nutrition: DataFrame
    interactions: DataFrame
    ratings: DataFrame | None = None
    min_reviews: int = 10
    min_recipes: int = 30
    staged: bool = True

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name) if self.staged else df

    @cached_property
    def valid(self) -> DataFrame:
        found = ingest.valid_recipes(self.recipes, self.ingredients, self.nutrition)
        return self._keep(found, "valid_recipes")

    # The tables of the valid recipes, one row per key. Repeats go before the key filter: then no recipe
    # has more rows than there are ingredients, and plain semi joins stay balanced.

    @cached_property
    def valid_recipe_rows(self) -> DataFrame:
        return self.recipes.join(self.valid, "RECIPE_ID", "left_semi")

    @cached_property
    def valid_nutrition(self) -> DataFrame:
        labelled = ingest.dedupe(self.nutrition, ["RECIPE_ID"])
        return labelled.join(self.valid, "RECIPE_ID", "left_semi")

    @cached_property
    def valid_ingredients(self) -> DataFrame:
        return list_rows(self.lists)

    @cached_property
    def lists(self) -> DataFrame:
        """The ingredients of each valid recipe as one list without repeats; for rows, training and test."""
        listed = recipe_lists(self.ingredients.select("RECIPE_ID", "ID_INGREDIENT"), distinct=True)
        return self._keep(listed.join(self.valid, "RECIPE_ID", "left_semi"), "recipe_lists")

    @cached_property
    def pairs(self) -> DataFrame:
        """Valid interactions with their copies added up: USER_ID, RECIPE_ID, type, N.

        Without ``ratings`` also RATING and REVIEWED, whether one of the copies is of type "review".
        """
        return self._keep(
            ingest.filter_by_keys(self._copies, self.valid, ["RECIPE_ID"], self.heavy_recipes), "pairs"
        )

    @cached_property
    def _copies(self) -> DataFrame:
        keys = ["USER_ID", "RECIPE_ID", "type"]
        if self.ratings is not None:
            typed = ingest.bucket_types(self.interactions.select("RECIPE_TYPE", "RECIPE_ID", "USER_ID"))
            return self._keep(group_count(typed, keys), "typed_pairs")
        # ratings come along with the count, so interactions are not built and added up a second time
        review = F.coalesce(F.col("RECIPE_TYPE") == "review", F.lit(False))
        rows = self.interactions.select(
            "RECIPE_TYPE", "RECIPE_ID", "USER_ID", F.when(review, F.col("RATING")).alias("RATING"), review.alias("REVIEWED")
        )
        counted = ingest.bucket_types(rows).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("N"), F.max("RATING").alias("RATING"), F.max("REVIEWED").alias("REVIEWED")
        )
        return self._keep(counted, "typed_pairs")

    # Heavy keys of all pairs, counted once: those of any part of them are among these.

    @cached_property
    def heavy_recipes(self) -> DataFrame:
        return self._heavy("RECIPE_ID")

    @cached_property
    def heavy_users(self) -> DataFrame:
        return self._heavy("USER_ID")

    def _heavy(self, key: str) -> DataFrame:
        total = self._copies.agg(F.count(F.lit(1))).scalar()
        return self._keep(heavy_keys(self._copies.select(key), [key], total=total), f"heavy_{key}")

    @cached_property
    def stats(self) -> DataFrame:
        return self._keep(user_stats(self.pairs, weight="N"), "user_stats")

    @cached_property
    def split(self) -> DataFrame:
        """USER_ID, RECIPE_ID, SPLIT; a pair can be on both sides, but on each only once."""
        return self._split.select("USER_ID", "RECIPE_ID", "SPLIT")

    @cached_property
    def _split(self) -> DataFrame:
        rows = sampling.type_split(
            self.stats, self.pairs, self.min_reviews, self.min_recipes, heavy=self.heavy_users
        )
        return self._keep(rows.drop("type", "N"), "type_split")

    @cached_property
    def training(self) -> DataFrame:
        return self.split.filter("SPLIT = 'train'").select("USER_ID", "RECIPE_ID")

    @cached_property
    def test(self) -> DataFrame:
        """Test pairs with their rating."""
        if self.ratings is None:
            rated = self._split.filter("SPLIT = 'test' AND REVIEWED AND USER_ID IS NOT NULL AND RECIPE_ID IS NOT NULL")
            return rated.select("USER_ID", "RECIPE_ID", "RATING")
        pairs = self.split.filter("SPLIT = 'test'").select("USER_ID", "RECIPE_ID")
        return self._keep(
            pairs.join(self.ratings.select("USER_ID", "RECIPE_ID", "RATING"), ["USER_ID", "RECIPE_ID"]),
            "rated_test",
        )

    @cached_property
    def idf(self) -> DataFrame:
        return profiles.ingredient_idf(self.valid_recipe_rows, self.valid_ingredients)

    def assets(self, side: str) -> dict[str, DataFrame]:
        """Recipes, ingredients and nutrition of one side of the split, one row per key."""
        tables = {
            "recipes": (self.valid_recipe_rows, ["RECIPE_ID"]),
            "ingredients": (self.valid_ingredients, ["RECIPE_ID", "ID_INGREDIENT"]),
            "nutrition": (self.valid_nutrition, ["RECIPE_ID"]),
        }
        return sampling.split_assets(self.split.filter(F.col("SPLIT") == side), tables)

    def nutrition_profile(self, how: str = "avg") -> DataFrame:
        return profiles.nutrition_profile(self.training, self.valid_nutrition, how, heavy=self.heavy_recipes)

    @cached_property
    def kept_idf(self) -> DataFrame:
        return self._keep(self.idf, "idf")

    def ingredient_profile(self, relative: bool = False, place: Placement | None = None) -> DataFrame:
        small = self.kept_idf.count() <= profiles.MOST_SMALL_IDF
        lists = self.lists
        if not small:
            weighted = profiles.weighted_ingredients(self.valid_ingredients, self.kept_idf)
            lists = self._keep(recipe_lists(weighted), "weighted_lists")
        return profiles.ingredient_profile(
            self.training,
            self.valid_ingredients,
            self.kept_idf,
            relative,
            place=place,
            lists=lists,
            heavy=self.heavy_recipes,
            small_idf=small,
        )

    @cached_property
    def place(self) -> Placement:
        return place_users(self.training, self.valid_ingredients, lists=self.lists)

    @cached_property
    def placed_profile(self) -> DataFrame:
        """The ingredient profile where ``place`` deals it; larger than any table, so it is not written."""
        return self.ingredient_profile(place=self.place)

    def ingredient_similarity(self) -> DataFrame:
        return similarity.ingredient_similarity(
            self.test,
            self.placed_profile,
            self.valid_ingredients,
            place=self.place,
            lists=self.lists,
            heavy=self.heavy_recipes,
        )

    @cached_property
    def similarities(self) -> DataFrame:
        return similarity.similarity_table(
            self.test,
            self.valid_nutrition,
            self.valid_ingredients,
            self._keep(self.nutrition_profile(), "nutrition_profile"),
            self.placed_profile,
            place=self.place,
            lists=self.lists,
            heavy=(self.heavy_recipes, self.heavy_users),
        )
