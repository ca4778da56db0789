"""Parquet, the format between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from mirepoix.sources.workspace import fresh_path


def write_columnar(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write Parquet, replacing what was there; returns the path."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    """Read a table in the session's default format (Parquet unless configured otherwise)."""
    return spark.read.load(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a table that several jobs reuse: its lineage ends at the files, so a lost executor never
    makes the cluster repeat the work that built it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.parquet(path)
    staged.staged_at = path
    return staged


def unstage(*tables: DataFrame | None) -> None:
    """Delete the files of tables that :func:`stage` returned and that nothing reads any more; others stay.

    To be called when all that was made from them is written itself: a lost executor then never needs them.
    """
    for table in tables:
        path = getattr(table, "staged_at", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
