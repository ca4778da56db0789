"""Repeatable pseudo-random fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(*columns: Column | str, seed: int = 0, portable: bool = False) -> Column:
    """Number in ``[0, 1)`` that depends on the values of ``columns`` and ``seed`` only.

    ``hash_fraction(user, recipe) < 0.7`` is a Bernoulli sample that survives repartitioning, task
    retries and re-evaluation. ``portable`` switches from xxhash64 to the leading 32 bits of an MD5
    digest, which other SQL engines can reproduce.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if portable:
        digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
