"""Joins that stay balanced when a few keys hold much of the data.

Aggregations need no help here: Spark combines them in the map tasks before it shuffles. A join has no
such step, so all rows of one key meet in one task. ``salted_join`` counts the keys first, spreads each
heavy key over several shards and copies the matching rows of the other side to those shards only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shard holds about so many rows, or a ``MOST_KEYS``-th of all rows if that is more.
SHARD_ROWS = 1_000_000
MOST_KEYS = 50_000

_ROWS, _SHARDS, _SALT = "__rows", "__shards", "__salt"


def heavy_keys(
    df: DataFrame, keys: Sequence[str], shard_rows: int | None = None, total: Column | None = None
) -> DataFrame:
    """The keys with more than ``shard_rows`` rows (default ``SHARD_ROWS``), and the number of shards to cut
    each into.

    No key with more than a ``MOST_KEYS``-th of all rows is left out, and no more than ``MOST_KEYS`` keys can
    have as many: the result is safe to broadcast whatever the size of ``df``. ``total`` is the number of rows, for
    when counting them is cheaper than adding up the keys once more.
    """
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS))
    if total is None:
        total = sized.agg(F.sum(_ROWS).alias(_ROWS)).scalar()
    least = F.greatest(F.lit(float(shard_rows or SHARD_ROWS)), total / MOST_KEYS)
    shards = F.ceil(F.col(_ROWS) / least).cast("int")
    return sized.filter(F.col(_ROWS) > least).select(*keys, shards.alias(_SHARDS))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    heavy: DataFrame | None = None,
    shard_rows: int | None = None,
    fan_out: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """USING join of a possibly skewed ``left`` with ``right``; same rows as the plain join.

    ``spread`` names the left columns whose hash picks the shard. By default that is all of them and the
    number of the map task, which also separates exact copies; both come out the same when a lost task
    is run again, as a random number need not. ``heavy`` is a result of :func:`heavy_keys` over some of the
    ``on`` columns, for when it can be had from a smaller table than ``left``. ``fan_out`` says that a
    row meets many: then both sides are shuffled, as a broadcast would leave the much larger output in
    the few tasks of the streamed side. ``tasks`` deals both sides to so many tasks, for when the output of a task
    would be too large otherwise.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot spread the left side of a {how} join")
    on = list(on)
    if heavy is None:
        heavy = heavy_keys(left, on, shard_rows)
    heavy_on = [c for c in heavy.columns if c != _SHARDS]
    hot = F.broadcast(heavy)
    shards = F.coalesce(F.col(_SHARDS), F.lit(1))

    mixed = F.xxhash64(*[F.col(c) for c in (spread or left.columns)])
    if spread is None:
        mixed = F.xxhash64(mixed, F.spark_partition_id())
    salt: Column = F.pmod(mixed, shards.cast("bigint"))
    if how in ("left", "left_anti"):
        # a null key matches nothing, so each of its rows may go anywhere
        missing = F.greatest(*[F.col(c).isNull() for c in on]) if len(on) > 1 else F.col(on[0]).isNull()
        salt = F.when(missing, F.pmod(mixed, F.lit(2**31 - 1).cast("bigint"))).otherwise(salt)
    spread_left = left.join(hot, heavy_on, "left").select(*left.columns, salt.cast("int").alias(_SALT))

    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()
    copied_right = right.join(hot, heavy_on, "left").select(
        *right.columns, F.explode(F.sequence(F.lit(0), shards - 1)).alias(_SALT)
    )
    if tasks is not None:
        spread_left, copied_right = (df.repartition(tasks, *on, _SALT) for df in (spread_left, copied_right))
    if fan_out or tasks is not None:
        copied_right = copied_right.hint("merge")
    return spread_left.join(copied_right, [*on, _SALT], how).drop(_SALT)
