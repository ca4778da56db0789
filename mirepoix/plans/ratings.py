"""The rating-propagation recommender: split, learn, predict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from mirepoix.operators import propagation, sampling
from mirepoix.operators.placement import Placement, place_users
from mirepoix.sources import stage


@dataclass
class PropagationRecommender:
    """``reviews`` needs USER_ID, RECIPE_ID, RATING (one row per pair), ``ingredients`` the recipe rows."""

    reviews: DataFrame
    ingredients: DataFrame
    min_reviews: int = 10
    max_users: int | None = None
    seed: int = 0
    portable: bool = False
    staged: bool = True

    @cached_property
    def split(self) -> DataFrame:
        """USER_ID, RECIPE_ID, RATING, SPLIT; ``train`` and ``test`` cannot overlap."""
        rated = sampling.percent_split(
            self.reviews.select("USER_ID", "RECIPE_ID", "RATING"),
            self.min_reviews,
            self.max_users,
            seed=self.seed,
            portable=self.portable,
        )
        return stage(rated, "rated_split") if self.staged else rated

    @cached_property
    def training(self) -> DataFrame:
        return self.split.filter("SPLIT = 'train'").drop("SPLIT")

    @cached_property
    def test(self) -> DataFrame:
        return self.split.filter("SPLIT = 'test'").drop("SPLIT")

    @cached_property
    def recipe_rows(self) -> DataFrame:
        """The recipe rows, which are counted and read for training and test."""
        rows = self.ingredients.select("RECIPE_ID", "ID_INGREDIENT")
        return stage(rows, "recipe_rows") if self.staged else rows

    @cached_property
    def place(self) -> Placement:
        return place_users(self.training, self.recipe_rows)

    @cached_property
    def propagated(self) -> DataFrame:
        return propagation.propagated_ratings(self.training, self.recipe_rows)

    @cached_property
    def predictions(self) -> DataFrame:
        learnt = propagation.propagated_ratings(self.training, self.recipe_rows, place=self.place)
        return propagation.propagation_predict(self.test, self.recipe_rows, learnt, place=self.place)
