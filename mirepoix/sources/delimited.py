"""Delimited text in and out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIPE: Mapping[str, str] = {"sep": "|", "encoding": "UTF-8"}
TAB: Mapping[str, str] = {"sep": "\t", "encoding": "UTF-8"}
#: Added to these: values as they stand, quote characters, spaces and backslashes included.
AS_IS: Mapping[str, str] = {
    "quote": "", "escape": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def delimited_path(folder: str, name: str) -> str:
    """``folder/name``, with ``.csv`` appended unless the name already mentions csv."""
    return f"{folder.rstrip('/')}/{name}" + ("" if "csv" in name else ".csv")


def read_delimited(
    spark: SparkSession,
    folder: str,
    name: str,
    options: Mapping[str, str] = PIPE,
    schema: StructType | str | None = None,
    quoted: bool = True,
    header: bool = True,
) -> DataFrame:
    """Read a delimited table, headed unless ``header`` is False: all strings, or typed by ``schema``.

    The schema is never inferred, so no extra pass over the files is made. ``quoted=False`` treats
    the quote character as data.
    """
    reader = spark.read.options(**options).option("header", header)
    if not quoted:
        reader = reader.option("quote", "")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(delimited_path(folder, name))


def write_delimited(
    df: DataFrame,
    folder: str,
    name: str,
    options: Mapping[str, str] = PIPE,
    header: bool = True,
    single_file: bool = False,
) -> str:
    """Write a folder of delimited files (one per task), replacing what was there; returns its path.

    ``single_file`` writes through one task: for reports, which have one row a score or threshold.
    """
    if single_file:
        df = df.coalesce(1)
    path = delimited_path(folder, name)
    df.write.mode("overwrite").options(**options).option("header", header).csv(path)
    return path


def write_report(df: DataFrame, folder: str, name: str, digits: int = 3) -> str:
    """Write a metric table as one pipe-separated file, numbers shown with ``digits`` decimals, nulls empty."""

    def shown_number(c: str):
        value = F.col(f"`{c}`").cast("double")
        return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).alias(c)

    shown = [
        shown_number(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes
    ]
    return write_delimited(df.select(*shown), folder, name, single_file=True)
