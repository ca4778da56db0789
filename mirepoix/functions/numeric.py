"""Scalar arithmetic on columns: scaling, rating rounding, cosine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax_scale(
    value: Column,
    old_min: float = 0.0,
    old_max: float = 1.0,
    new_min: float = 0.0,
    new_max: float = 5.0,
) -> Column:
    """Map ``[old_min, old_max]`` linearly onto ``[new_min, new_max]``."""
    if old_max == old_min:
        raise ValueError("minmax_scale needs a non-empty source interval")
    stretch = (new_max - new_min) / (old_max - old_min)
    return (value - F.lit(float(old_min))) * F.lit(float(stretch)) + F.lit(float(new_min))


def rating_round(value: Column, mode: str = "upward") -> Column:
    """Turn a continuous score into an integer rating.

    ``upward`` raises every positive fraction to the next rating, except that scores below one half
    become 0, and takes negative scores down. ``nearest`` rounds half up.
    """
    if mode == "nearest":
        return F.floor(value + F.lit(0.5)).cast("int")
    if mode != "upward":
        raise ValueError(f"unknown rounding mode {mode!r}")
    return (
        F.when(value < 0, F.floor(value))
        .when(value < 0.5, F.lit(0))
        .otherwise(F.ceil(value))
        .cast("int")
    )


def column_min(a: Column, b: Column) -> Column:
    """Smaller of two columns; ``b`` when either is null (``least`` would skip the null)."""
    return F.when(a <= b, a).otherwise(b)


def _zero_if_null(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def dot(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Inner product of two column lists; a null component counts as 0."""
    return reduce(add, (_zero_if_null(a) * _zero_if_null(b) for a, b in zip(left, right, strict=True)))


def l2_norm(columns: Sequence[Column]) -> Column:
    """Euclidean length of a column list; a null component counts as 0."""
    return F.sqrt(dot(columns, columns))


def cosine(
    left: Sequence[Column],
    right: Sequence[Column],
    left_norm: Column | None = None,
    right_norm: Column | None = None,
) -> Column:
    """Cosine of two column lists, null when either has length 0.

    Pass the norms when they are already at hand, so that a join does not compute them per pair.
    """
    lengths = (left_norm if left_norm is not None else l2_norm(left)) * (
        right_norm if right_norm is not None else l2_norm(right)
    )
    return F.try_divide(dot(left, right), lengths)


def steady(value: Column, digits: int = 10) -> Column:
    """Cut off floating noise that depends on the order of a distributed sum.

    Without it a mean of exactly 3 may come out one ulp above 3 and be rounded up to rating 4.
    """
    return F.round(value, digits)
