"""A user's rows in one place: lists of ingredients travel to users, not one row per ingredient.

A recipe meets many users and has many ingredients, so the rows (user, ingredient) are far more than either table.
Here each pair takes its recipe's ingredients along as one list; the list is opened only in the task that holds the
user. What is learnt per ingredient and the pairs to be scored are dealt alike, so they meet without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.skew import MOST_KEYS, SHARD_ROWS, heavy_keys, salted_join

#: Rows a task holds, on average.
TASK_ROWS = 1_000_000
#: Opened rows a task of users holds, on average: it aggregates and sorts them, so they should fit its memory.
USER_ROWS = 250_000
#: Tasks of users whose pairs meet their lists in one task: it holds lists, not opened rows.
USERS_A_JOIN = 64
#: Fewer tasks than this are left to Spark, which may broadcast the lists.
LEAST_JOINS = 16

#: Shard of a heavy user; its ingredients are dealt to the shards by their hash.
PART = "__part"
#: True for rows of pairs, false for rows of what is learnt.
ASKED = "__asked"
#: Learnt rows that a row of a pair meets.
HITS = "__hits"

_LIST, _SHARDS = "__list", "__shards"


def tasks_for(rows: float | None, task_rows: int = TASK_ROWS) -> int:
    """Tasks that hold ``task_rows`` each."""
    return max(1, -(-int(rows or 0) // task_rows))


@dataclass(frozen=True)
class Placement:
    """Number of tasks, and the shards of users too heavy for one (None if there are none)."""

    tasks: int
    heavy: DataFrame | None = None

    def keys(self, user: str) -> list[str]:
        return [user] if self.heavy is None else [user, PART]

    @property
    def joins(self) -> int | None:
        """Tasks in which pairs get their lists, none of which has too large an output; None if Spark may choose."""
        tasks = -(-self.tasks // USERS_A_JOIN)
        return tasks if tasks >= LEAST_JOINS else None

    def deal(self, df: DataFrame, user: str) -> DataFrame:
        return df.repartition(self.tasks, *self.keys(user))

    def _shards(self, df: DataFrame, user: str) -> DataFrame:
        n = F.coalesce(F.col(_SHARDS), F.lit(1))
        return df.join(F.broadcast(self.heavy), user, "left").select(*df.columns, n.alias(_SHARDS))

    def cut_lists(self, df: DataFrame, user: str, ingredient: str) -> DataFrame:
        """A row for each shard of its user, with the ingredients of that shard."""
        if self.heavy is None:
            return df
        shards = F.sequence(F.lit(0), F.col(_SHARDS) - 1)
        cut = self._shards(df, user).withColumn(PART, F.explode(shards))
        own = F.filter(_LIST, lambda x: _shard(x[ingredient]) == F.col(PART))
        return cut.withColumn(_LIST, F.when(F.col(_SHARDS) == 1, F.col(_LIST)).otherwise(own)).drop(_SHARDS)

    def tag(self, df: DataFrame, user: str, ingredient: str) -> DataFrame:
        """Add the shard each row belongs to, if users have shards and it is missing."""
        if self.heavy is None or PART in df.columns:
            return df
        return self._shards(df, user).withColumn(PART, _shard(F.col(ingredient))).drop(_SHARDS)


def _shard(ingredient: Column) -> Column:
    return F.pmod(F.xxhash64(ingredient), F.col(_SHARDS).cast("bigint")).cast("int")


def place_users(
    pairs: DataFrame,
    ingredients: DataFrame,
    recipe: str = "RECIPE_ID",
    user: str = "USER_ID",
    task_rows: int = USER_ROWS,
    shard_rows: int | None = None,
    lists: DataFrame | None = None,
) -> Placement:
    """Placement for about as many opened rows as ``pairs`` have; counts both tables, so have them staged.

    ``lists`` are the ``recipe_lists`` of ``ingredients``, whose lengths need no shuffle.
    """
    sizes = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    if lists is None:
        lengths = ingredients.groupBy(recipe).agg(F.count(F.lit(1)).alias("n"))
    else:
        lengths = lists.select(F.size(_LIST).alias("n"))
    length = lengths.agg(F.avg("n").alias("length"))
    found = sizes.crossJoin(length).first()
    rows, most = found["n"] or 0, found["most"] or 0
    is_heavy = most > max(shard_rows or SHARD_ROWS, rows / MOST_KEYS)
    heavy = heavy_keys(pairs.select(user), [user], shard_rows) if is_heavy else None
    return Placement(tasks_for(rows * max(found["length"] or 1, 1), task_rows), heavy)


def recipe_lists(ingredients: DataFrame, recipe: str = "RECIPE_ID", distinct: bool = False) -> DataFrame:
    """One row per recipe: its ingredient rows as a list, with ``distinct`` each once. For :func:`open_lists`, when
    several need it."""
    values = [c for c in ingredients.columns if c != recipe]
    collect = F.collect_set if distinct else F.collect_list
    return ingredients.groupBy(recipe).agg(collect(F.struct(*values)).alias(_LIST))


def list_rows(lists: DataFrame) -> DataFrame:
    """The ingredient rows that :func:`recipe_lists` made ``lists`` of."""
    return lists.select(*[c for c in lists.columns if c != _LIST], F.explode(_LIST).alias("__e")).select(
        *[c for c in lists.columns if c != _LIST], "__e.*"
    )


def open_lists(
    pairs: DataFrame,
    ingredients: DataFrame,
    place: Placement,
    recipe: str,
    user: str,
    ingredient: str,
    how: str = "inner",
    lists: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``pairs`` with one row per ingredient of their recipe (``ingredients`` without ``recipe``), dealt by user.

    A left join keeps a pair whose recipe lists nothing as one row with nulls. ``lists`` are the ``recipe_lists`` of
    ``ingredients`` and may hold more columns; ``heavy`` are the heavy recipes of ``pairs``.
    """
    values = [c for c in ingredients.columns if c != recipe]
    if lists is None:
        lists = recipe_lists(ingredients, recipe)
    joined = salted_join(pairs, lists, [recipe], how, spread=[user], heavy=heavy, tasks=place.joins)
    found = place.cut_lists(joined, user, ingredient)
    # one array per value: half the bytes of an array of structs
    arrays = [F.col(_LIST)[v].alias(f"__l_{i}") for i, v in enumerate(values)]
    dealt = place.deal(found.select(*[c for c in found.columns if c != _LIST], *arrays), user)
    rows = F.arrays_zip(*[f"__l_{i}" for i in range(len(values))])
    opened = (F.explode_outer if how == "left" else F.explode)(rows).alias("__e")
    kept = [c for c in dealt.columns if not c.startswith("__l_")]
    return dealt.select(*kept, opened).select(*kept, *[F.col(f"__e.__l_{i}").alias(v) for i, v in enumerate(values)])


def meet(
    learnt: DataFrame,
    asked: DataFrame,
    keys: Sequence[str],
    ingredient: str,
    values: Sequence[str],
) -> DataFrame:
    """Rows of ``asked`` with the sum (``__sum_<value>``) and number (``__n_<value>``) of each value of the learnt rows of
    their keys and ingredient, and ``HITS``, the number of those; a null key or ingredient meets none. The rows of
    ``learnt`` stay, marked by ``ASKED``.

    What is learnt comes first in each group and sums run on, so no group is held in memory.
    """
    user = keys[0]
    both = learnt.select(*keys, ingredient, *values).withColumn(ASKED, F.lit(False)).unionByName(
        asked.withColumn(ASKED, F.lit(True)), allowMissingColumns=True
    )
    so_far = W.partitionBy(*keys, ingredient).orderBy(ASKED).rowsBetween(W.unboundedPreceding, W.currentRow)
    matches = F.col(user).isNotNull() & F.col(ingredient).isNotNull()

    def known(column: Column) -> Column:
        return F.when(matches, column.over(so_far))

    return both.select(
        *both.columns,
        F.coalesce(known(F.count_if(~F.col(ASKED))), F.lit(0)).alias(HITS),
        *[known(F.sum(v)).alias(f"__sum_{v}") for v in values],
        *[F.coalesce(known(F.count(v)), F.lit(0)).alias(f"__n_{v}") for v in values],
    )
