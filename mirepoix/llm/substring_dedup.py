"""Passages repeated across documents: paragraphs, MinHash bands, exact Jaccard, components.

Paragraphs are the lines of a text that have enough words. Equal ones are one class from the start; classes
that share a band are compared on their full shingle sets, as documents are in ``near_dedup``.

A passage that was copied into the middle of a longer paragraph leaves the paragraphs unlike each other. For
these, stretches of ``STRETCH`` words are taken as paragraphs of their own wherever the hash of the stretch
is the least in its surroundings. Two documents that share a run of ``STRETCH + WINDOW - 1`` words (50) share
at least one such stretch, whatever stands around the run; stretches are compared for equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mirepoix.llm.common import (
    MinMaxHash,
    likely_in,
    mix,
    shingles,
    shingles_in_order,
    signed,
    small_batches,
    spread_join,
    word_hashes,
)
from mirepoix.llm.near_dedup import linked_groups
from mirepoix.sources import stage, unstage

#: 21 permutations give 42 values in 14 bands of 3: a pair at similarity 0.8 is missed with 4e-5.
PERMUTATIONS, BANDS = 21, 14
#: Words of a stretch, and stretches among which the one of least hash is taken.
STRETCH, WINDOW = 20, 31
LEAST_WORDS = 40


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of :func:`word_hashes` and the place of each line feed, in code points."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)], points[np.flatnonzero(data == 10)]


def lines_of(starts: np.ndarray, feeds: np.ndarray, n_points: int, least_words: int):
    """Lines of enough words: start and end in code points, first word, word after the last."""
    line = np.searchsorted(feeds, starts)
    words = np.bincount(line, minlength=len(feeds) + 1)
    first = np.cumsum(words) - words
    own = np.flatnonzero(words >= max(1, least_words))
    return np.append(0, feeds + 1)[own], np.append(feeds, n_points)[own], first[own], (first + words)[own]


def stretch_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the ``STRETCH`` words from each word on, from hashes of stretches of half the length."""
    step = np.uint64(0x9E3779B97F4A7C15)
    by_length = {1: words}
    n = 1
    while 2 * n <= STRETCH:
        half = by_length[n]
        by_length[2 * n] = mix(half[:-n] * step + half[n:])
        n *= 2
    out, done = by_length[n], n
    while done < STRETCH:
        n //= 2
        if STRETCH - done >= n:
            rest = by_length[n][done:]
            out = mix(out[: len(rest)] * step + rest)
            done += n
    return out


def described(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, least_words: int) -> DataFrame:
    """``(id, keys, start, end, words, h1, h2)`` of each paragraph (with ``keys``, its bands) and of each stretch that
    is least in a window (without), from one pass over the texts. Positions are code points, the end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"id {kind}, keys array<bigint>, start bigint, end bigint, words bigint, h1 bigint, h2 bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMaxHash(PERMUTATIONS, BANDS)
        for batch in small_batches(batches, "text"):
            docs_of, sets, rows = [], [], [np.empty((0, 5), np.int64)]
            of_stretches, stretches = [], [np.empty((0, 5), np.int64)]
            for number, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(text)
                if not len(words) or len(words) < min(least_words, STRETCH + WINDOW - 1):
                    continue
                starts, ends, feeds = word_places(text)
                start, end, first, after = lines_of(starts, feeds, len(text), least_words)
                if len(start):
                    every = shingles_in_order(words, shingle_words)
                    for a, b in zip(first.tolist(), after.tolist(), strict=True):
                        sets.append(every[a : b - shingle_words + 1] if b - a > shingle_words else shingles(words[a:b], shingle_words))
                    fp = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(first, after, strict=True)]
                    fp = np.frombuffer(b"".join(fp), np.int64).reshape(-1, 2)
                    rows.append(np.column_stack([start, end, after - first, fp]))
                    docs_of += [number] * len(start)
                if len(words) >= STRETCH + WINDOW - 1:
                    hashes = stretch_hashes(words)
                    least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).argmin(axis=1)
                    at = np.unique(least + np.arange(len(least)))
                    second = mix(hashes[at] ^ words[at])
                    n = np.full(len(at), STRETCH)
                    stretches.append(np.column_stack([starts[at], ends[at + STRETCH - 1], n, signed(hashes[at]), signed(second)]))
                    of_stretches += [number] * len(at)
            keys = hashing.keys_of_all(sets).reshape(-1)
            offsets = np.append(np.arange(len(sets) + 1) * BANDS, np.full(len(of_stretches), len(keys)))
            banded = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(keys), mask=pa.array([False] * len(sets) + [True] * len(of_stretches), pa.bool_())
            )
            values = np.concatenate([*rows, *stretches])
            ids = batch.column(0).take(pa.array(docs_of + of_stretches, pa.int64()))
            columns = [ids, banded, *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(5))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def paragraph_sets(texts: DataFrame, shingle_words: int, least_words: int) -> DataFrame:
    """``(id, items)`` of the paragraphs that ``texts``, rows ``(text, wanted)``, are wanted for: structs
    ``(class, h1, h2)``, of which ``class`` is the id."""
    schema = "id bigint, items array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids, sets = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                classes = {(w["h1"], w["h2"]): w["class"] for w in wanted}
                words = word_hashes(text)
                starts, _, feeds = word_places(text)
                for a, b in zip(*lines_of(starts, feeds, len(text), least_words)[2:], strict=True):
                    found = np.frombuffer(xxhash.xxh3_128_digest(words[a:b].tobytes()), np.int64).tolist()
                    name = classes.pop(tuple(found), None)
                    if name is not None:
                        ids.append(name)
                        sets.append(signed(shingles(words[a:b], shingle_words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((ids, sets), arrow, strict=True)], schema=arrow)

    return texts.select("text", "wanted").mapInArrow(run, schema)


def repeated_stretches(found: DataFrame) -> DataFrame:
    """``(id, start, end, first)`` of the stretches that another document has too."""
    shared = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last"))
    shared = stage(shared.filter("first.id <> last").drop("last"), "shared")
    return spread_join(found, shared, ["h1", "h2"], "id", how="inner").select("id", "start", "end", "first")


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Every paragraph of at least ``least_words`` words that is repeated in another document, one row each:
    ``(id_col, start, end, n_words, first_id, first_start, kept, kind)``; and the stretches of longer runs.

    Paragraphs are linked if 100 * intersection >= ``percent`` * union of their word shingles. A group is named by
    its first paragraph (smallest document, then place), which is ``kept``; the others are to be removed.
    Groups within one document are left out. Null, empty and shorter texts have no rows; a repeated row of
    ``docs`` counts as the same document. Other columns are ignored.
    """
    every = stage(described(docs, id_col, text_col, shingle_words, least_words), "passages")
    lines = every.filter("keys is not null")
    place = F.struct("id", "start")
    classes = lines.groupBy("h1", "h2").agg(F.first("keys").alias("keys"), F.min(place).alias("first"), F.max("id").alias("last"))
    # numbers are made once, as the table is written
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # the first paragraph of each wanted class, from its document: texts of other documents stay where they are,
        # and sets are made where the text is
        homes = classes.join(wanted.withColumnRenamed("id", "class"), "class", "left_semi")
        homes = homes.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct("class", "h1", "h2")).alias("wanted"))
        homes = stage(homes, "homes")
        texts = likely_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), homes, "id")
        # shuffled by the document whatever the size, so repeated rows of it are in one task already
        texts = texts.join(homes.hint("merge"), "id").distinct()
        return paragraph_sets(texts, shingle_words, least_words)

    groups = linked_groups(classes.select(F.col("class").alias("id"), "keys"), sets_of, percent)
    named = classes.select("class", "h1", "h2", "first", "last").join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "class")), "named")
    whole = named.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = stage(whole.filter("first.id <> last"), "repeated")
    kept = stage(named.select("h1", "h2", "component").join(whole, "component").select("h1", "h2", "first"), "kept")
    unstage(classes, groups, named, whole)
    out = spread_join(lines.select("id", "start", "end", "words", "h1", "h2"), kept, ["h1", "h2"], "id", how="inner")
    out = out.select("id", "start", "end", "words", "first", F.lit("paragraph").alias("kind"))
    runs = repeated_stretches(every.filter("keys is null").select("id", "start", "end", "h1", "h2"))
    runs = runs.select("id", "start", "end", F.lit(STRETCH).cast("bigint").alias("words"), "first", F.lit("stretch").alias("kind"))
    return out.unionByName(runs).select(
        F.col("id").alias(id_col),
        "start",
        "end",
        F.col("words").alias("n_words"),
        F.col("first.id").alias("first_id"),
        F.col("first.start").alias("first_start"),
        ((F.col("id") == F.col("first.id")) & (F.col("start") == F.col("first.start"))).alias("kept"),
        "kind",
    )
