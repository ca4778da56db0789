"""From crawl text to typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cast_except(
    df: DataFrame, keys: Sequence[str], to: str = "double", key_type: str | None = None
) -> DataFrame:
    """Keys first, every other column cast to ``to``; text that is no number becomes null."""
    heads = [F.col(f"`{k}`").try_cast(key_type).alias(k) if key_type else F.col(f"`{k}`") for k in keys]
    rest = [F.col(f"`{c}`").try_cast(to).alias(c) for c in df.columns if c not in set(keys)]
    return df.select(*heads, *rest)
