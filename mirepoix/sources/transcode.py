"""Re-encode text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirepoix.sources.columnar import stage

#: The bytes of a line feed and of a carriage return, and the mark that begins such a file.
UTF_16 = {"UTF-16LE": (b"\n\0", b"\r\0", b"\xff\xfe"), "UTF-16BE": (b"\0\n", b"\0\r", b"\xfe\xff")}
BREAK = r"\r\n|\r|\n"


def read_encoded_lines(spark: SparkSession, folder: str, encoding: str = "UTF-16") -> DataFrame:
    """(path, line_no, line) of the files of ``folder``, decoded from ``encoding``; lines are numbered from 0.

    Lines end at LF, CR or both; what follows the last line end is a line unless it is empty. ``UTF-16`` looks at
    the mark at the beginning of each file (without one it is big-endian); a mark is no part of the first line.

    Files are read in byte ranges by as many tasks as Spark cuts them for, whatever their size. A range is cut at
    the two bytes of a line feed. Where these happen to be the second byte of one character and the first of the next,
    records of odd length come about; only files with such records, or with a CR alone, are put together again, by
    counting bytes range by range.
    """
    kind = encoding.upper()
    if kind == "UTF-16":
        little, big = (_lines(spark, folder, k, True) for k in UTF_16)
        return little.unionByName(big)
    if kind in UTF_16:
        return _lines(spark, folder, kind, False)
    return _lines(spark, folder, encoding, False)


def _records(spark: SparkSession, folder: str, encoding: str) -> DataFrame:
    """(path, block, pos, raw): what lies between the bytes of line feeds; ``pos`` ascends within a range."""
    feed = UTF_16[encoding][0] if encoding in UTF_16 else b"\n"
    return (
        spark.read.option("lineSep", feed.decode("ascii"))
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").cast("binary").alias("raw"),
        )
    )


def _before(column: str, by: list[str], order: list[str]) -> Column:
    """Sum of ``column`` over the rows before."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0).cast("bigint"))


def _lines(spark: SparkSession, folder: str, encoding: str, marked: bool) -> DataFrame:
    records = _records(spark, folder, encoding)
    unit = 2 if encoding in UTF_16 else 1
    feed, cr, mark = UTF_16.get(encoding, (b"\n", b"\r", b""))
    ends_in_cr = F.substring("raw", F.octet_length("raw") - unit + 1, F.lit(unit)) == F.lit(cr)
    body = F.when(ends_in_cr, F.substring("raw", F.lit(1), F.octet_length("raw") - unit)).otherwise(F.col("raw"))

    blocks = records.groupBy("path", "block").agg(
        F.min("pos").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("raw") + unit).alias("bytes"),
        F.max((F.octet_length("raw") % unit != 0) | F.contains(body, F.lit(cr))).alias("odd"),
        F.min(F.struct("pos", F.substring("raw", 1, 2).alias("bytes"))).alias("head"),
    )
    # one row a range of a file
    blocks = stage(blocks, "ranges")
    files = blocks.groupBy("path").agg(
        F.max("odd").alias("odd"), F.min_by("head.bytes", "block").alias("head")
    )
    little, big = UTF_16["UTF-16LE"][2], UTF_16["UTF-16BE"][2]
    if marked:
        files = files.filter((F.col("head") == F.lit(little)) == F.lit(mark == little))
    skip = F.when(F.col("head") == F.lit(mark), len(mark)).otherwise(0)
    blocks = blocks.drop("odd", "head").join(files.withColumn("skip", skip).drop("head"), "path")
    blocks = blocks.withColumns({"lines": _before("n", ["path"], ["block"]), "offset": _before("bytes", ["path"], ["block"])})
    blocks = stage(blocks, "numbered_ranges")

    def text(raw: Column) -> Column:
        return F.decode(raw, encoding)

    def unmarked(raw: Column, line_no: Column) -> Column:
        return F.when((line_no == 0) & (F.col("skip") > 0), F.substring(raw, F.col("skip") + 1, F.octet_length(raw))).otherwise(raw)

    # files in order: a record is a line, numbered by its range and its place there
    usual = records.join(blocks.filter("not odd"), ["path", "block"])
    usual = usual.withColumn("line_no", F.col("lines") + F.col("pos") - F.col("first")).withColumn("raw", body)
    usual = usual.select("path", "line_no", text(unmarked(F.col("raw"), F.col("line_no"))).alias("line"))
    if blocks.filter("odd").isEmpty():
        return usual

    # records that end at an odd byte go on with the next one
    pieces = records.join(blocks.filter("odd"), ["path", "block"])
    place = Window.partitionBy("path", "block").orderBy("pos")
    length = F.octet_length("raw") + unit
    pieces = pieces.withColumn("end", F.col("offset") + F.sum(length).over(place))
    pieces = pieces.withColumn("whole", (F.col("end") % unit == 0).cast("bigint"))
    pieces = pieces.withColumn("record", _before("whole", ["path", "block"], ["pos"]))
    pieces = stage(pieces.select("path", "block", "pos", "raw", "whole", "record", "skip"), "pieces")
    counts = pieces.groupBy("path", "block").agg(F.sum("whole").alias("records"))
    counts = counts.select("path", "block", _before("records", ["path"], ["block"]).alias("before"))
    pieces = pieces.join(counts, ["path", "block"]).withColumn("record", F.col("record") + F.col("before"))
    joined = pieces.groupBy("path", "record", "skip").agg(
        F.min("block").alias("block"), F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "raw"))), lambda p: p["raw"]).alias("raws")
    )
    whole = F.aggregate(
        F.slice("raws", F.lit(2), F.size("raws")), F.element_at("raws", 1), lambda a, raw: F.concat(a, F.lit(feed), raw)
    )
    # a CR at the end belongs to the line feed that follows
    lines = F.split(F.regexp_replace(text(unmarked(whole, F.col("record"))), r"\r\z", ""), BREAK)
    joined = stage(joined.select("path", "block", "record", lines.alias("parts")), "records")
    counts = joined.groupBy("path", "block").agg(F.sum(F.size("parts")).alias("n"))
    counts = counts.select("path", "block", _before("n", ["path"], ["block"]).alias("lines"))
    joined = joined.withColumn("n", F.size("parts").cast("bigint"))
    joined = joined.withColumn("at", _before("n", ["path", "block"], ["record"])).join(counts, ["path", "block"])
    odd = joined.select("path", (F.col("lines") + F.col("at")).alias("first"), F.posexplode("parts").alias("i", "line"))
    return usual.unionByName(odd.select("path", (F.col("first") + F.col("i")).alias("line_no"), "line"))


def transcode(
    spark: SparkSession,
    source: str,
    target: str,
    from_encoding: str = "UTF-16",
    to_encoding: str = "UTF-8",
    line_end: str = "\r\n",
    lines_per_file: int = 5_000_000,
) -> str:
    """Copy a folder of text files to ``to_encoding``; one sub-folder per source file name.

    A source file of up to ``lines_per_file`` lines becomes one file; a longer one is written by several tasks, as
    ``part=0``, ``part=1``, ... below its folder, each with its lines in order.
    """
    lines = read_encoded_lines(spark, source, from_encoding)
    name = F.element_at(F.split("path", "/"), -1)
    rows = lines.select(
        F.col("line").alias("value"), name.alias("source_file"), F.floor(F.col("line_no") / lines_per_file).alias("part"), "line_no"
    )
    (
        rows.repartition("source_file", "part")
        .sortWithinPartitions("source_file", "part", "line_no")
        .select("value", "source_file", "part")
        .write.mode("overwrite")
        .partitionBy("source_file", "part")
        .option("encoding", to_encoding)
        .option("lineSep", line_end)
        .text(target)
    )
    return target
