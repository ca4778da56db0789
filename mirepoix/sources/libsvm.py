"""LIBSVM text: sparse vectors with a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, features) rows; naming ``n_features`` saves the pass that would count them."""
    reader = spark.read.format("libsvm")
    if n_features is not None:
        reader = reader.option("numFeatures", str(n_features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> str:
    """Write a label and an array of numbers as sparse LIBSVM lines; returns the path.

    Features are numbered from 1; zeros and nulls are left out, a null array has no features, a null label is 0.
    """
    entry = F.transform(
        F.coalesce(F.col(f"`{features}`").cast("array<double>"), F.array().cast("array<double>")),
        lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string"))),
    )
    head = F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(0.0)).cast("string")
    # concat_ws leaves out nulls
    df.select(F.concat_ws(" ", head, entry).alias("value")).write.mode("overwrite").text(path)
    return path
