"""Column expressions: everything here returns a ``Column`` and stays JVM-side."""

from mirepoix.functions.numeric import column_min, cosine, dot, l2_norm, minmax_scale, rating_round, steady
from mirepoix.functions.sampling import hash_fraction

__all__ = [
    "column_min",
    "cosine",
    "dot",
    "hash_fraction",
    "l2_norm",
    "minmax_scale",
    "rating_round",
    "steady",
]
