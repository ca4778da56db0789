"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Texts are tokenized and cut into pieces of at most ``size`` tokens. Only the histogram of piece lengths
(``size`` numbers at most) reaches the driver, where lengths are placed longest first, each on the packs
that are shortest so far, as patterns with counts. Pieces find their places by their rank within their
length: ranks come from counts by (length, shard), so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirepoix.llm.bpe import encoder
from mirepoix.llm.common import give_back, small_batches
from mirepoix.sources import stage

#: About so many pieces are ranked together in a task.
SHARD_ROWS = 2_000


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold pieces of these ``lengths``, in this order."""

    lengths: tuple[int, ...]
    count: int


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that place every piece of the histogram ``{length: pieces}``.

    The longest lengths go first; pieces of a length go to the packs with the most room that can take them, at
    the latest to new ones. Packs of equal content are one pattern with a count, so the work depends on the
    number of different lengths only.
    """
    if histogram and not 0 < min(histogram) <= max(histogram) <= size:
        raise ValueError("lengths must lie between 1 and the size of a sequence")
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, pattern: Pattern) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop()
            else:
                room, pattern = size, Pattern((), left // (size // length) or 1)
            n = min(left, pattern.count)
            if n < pattern.count and pattern.lengths:
                put(room, Pattern(pattern.lengths, pattern.count - n))
            put(room - length, Pattern((*pattern.lengths, length), n))
            left -= n
    return [p for room in rooms for p in by_room[room]]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)`` of each piece: full ones of ``size`` ids, then the rest."""
    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = encoder(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in small_batches(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), coded.encode(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(ids + end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    row = (doc, start, len(part) // 4, zlib.crc32(part), total)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
            give_back()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length.

    Rows are numbered within (length, shard), the shard being a hash of the piece; the shards before add up
    from their counts.
    """
    shards = max(1, -(-total // SHARD_ROWS))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start"), F.lit(shards)))
    counts = stage(sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "shard_counts")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "shard").orderBy("id", "start")
    numbered = sharded.withColumn("at", F.row_number().over(own) - 1)
    return numbered.join(starts, ["length", "shard"]).withColumn("rank", F.col("first") + F.col("at")).drop("shard", "first", "at")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """One row a piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids (no added tokens) and ``end_id``; null and empty texts are ``end_id`` alone.
    Every id lies in one piece, every sequence holds at most ``size`` ids without gaps from offset 0.
    Repeated documents are packed repeatedly; other columns are ignored; an empty table gives no rows.
    Ids of documents are integers; null ones stay null.
    """
    cut = stage(pieces(docs, tokenizer_path, id_col, text_col, size, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = place(shortest_pack_first(histogram, size))
    keys, firsts, sequences, offsets = (slots[:, i] for i in range(4))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            at = np.empty(len(rows), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(keys, [n, n + 1])
                own = length == n
                at[own] = lo + np.searchsorted(firsts[lo:hi], rank[own], side="right") - 1
            rows["sequence_id"] = sequences[at] + rank - firsts[at]
            rows["offset"] = offsets[at]
            yield rows.drop(columns="rank")

    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    placed = ranked(cut, sum(histogram.values())).select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return placed.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def place(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: a slot of a pattern takes as
    many ranks of its length as the pattern has sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length in p.lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + p.count
            offset += length
        sequence += p.count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)
