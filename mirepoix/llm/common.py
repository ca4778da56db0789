"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mirepoix.sources import stage, unstage

#: Rows and bytes of text that a Python task holds at a time; a single longer text is a batch of its own.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def small_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``BATCH_BYTES`` of ``text``, so that a task's memory follows the
    longest text and not the number of rows in an Arrow batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        width = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(width) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns free memory to the system. Workers outlive their stage, and Arrow's pool and the C library's heap
    both keep what the longest text took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_texts(
    df: DataFrame, text: str, keep: list[str], rows: Callable[[list], Iterator[tuple]], schema: str
) -> DataFrame:
    """``keep`` columns and what ``rows`` computes from a list of texts, one tuple a text.

    ``schema`` names the computed columns; names of ``keep`` may be any. Runs over Arrow batches, cut small by :func:`small_batches`.
    """
    # columns travel under numbers, so that no name can clash or need quotes
    kept = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text")
    )
    out = StructType(kept.schema.fields[:-1])
    made = StructType.fromDDL(schema)
    for i, field in enumerate(made):
        out = out.add(f"v{i}", field.dataType)
    arrow = to_arrow_schema(out)
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column(n_kept).to_pylist()
            values_of = list(zip(*rows(texts), strict=True))
            columns = [batch.column(i) for i in range(n_kept)]
            for values, field in zip(values_of, list(arrow)[n_kept:], strict=True):
                columns.append(pa.array(values, type=field.type))
            del texts, values_of
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )
            give_back()

    return kept.mapInArrow(run, out).toDF(*keep, *made.names)


# --- words and shingles --------------------------------------------------------------------------

#: Words a worker remembers before it starts anew, some 200 bytes each.
_WORDS_MOST = 200_000
_WORDS: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: A-Z lower-cased, parted by space and ``\\x09-\\x0D``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_WORDS) > _WORDS_MOST:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (a bijection of 64-bit values)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; with fewer words, of the whole sequence."""
    return np.unique(shingles_in_order(hashes, k))


def shingles_in_order(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the shingle from each word on."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(k, n)
    acc = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return acc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


class MinMaxHash:
    """Both the minimum and the maximum of a set under each of ``permutations`` random permutations.

    Two sets agree in the minimum with their Jaccard similarity as probability, and so in the maximum: one
    evaluation of a permutation gives two values of the signature.
    """

    def __init__(self, permutations: int, bands: int, seed: int = 7):
        if 2 * permutations % bands:
            raise ValueError("the values of a signature must divide evenly into bands")
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, permutations, dtype=np.uint64)
        self.bands = bands

    def signature(self, values: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        for i in range(0, len(values), 2048):
            h = self.a[:, None] * values[None, i : i + 2048] + self.b[:, None]
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        return np.stack([low, high], axis=1).reshape(-1)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One bucket key for each band."""
        return self._banded(self.signature(values)[None])[0]

    def _banded(self, signatures: np.ndarray) -> np.ndarray:
        rows = signatures.reshape(len(signatures), self.bands, -1)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)[None]
        for i in range(rows.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
        return signed(key)

    def keys_of_all(self, sets: list[np.ndarray], at_once: int = 32_768) -> np.ndarray:
        """The keys of many sets, none empty; a set may list a value more than once."""
        out, i = [np.empty((0, self.bands), np.int64)], 0
        sizes = np.array([len(s) for s in sets], np.int64)
        while i < len(sets):
            # as many sets as fit, one at least
            j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), at_once, side="right")) + i)
            if j == i + 1:
                made = self.signature(sets[i])[None]
            else:
                h = self.a[:, None] * np.concatenate(sets[i:j])[None] + self.b[:, None]
                starts = np.cumsum(sizes[i:j]) - sizes[i:j]
                low, high = np.minimum.reduceat(h, starts, axis=1), np.maximum.reduceat(h, starts, axis=1)
                made = np.stack([low.T, high.T], axis=2).reshape(j - i, -1)
            out.append(self._banded(made))
            i = j
        return np.concatenate(out)


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of each node of ``edges`` (columns ``a``, ``b``); a component is named by its
    smallest node.

    Every node hooks to its smallest neighbour if that is smaller, hooks are followed to their roots by
    pointer jumping, and edges are contracted to the roots, until none is left. The tables of a round are
    written to the shared folder, so lineage stays short; nothing but emptiness tests reaches the driver.
    A hub's rows meet in joins of two plain tables, which adaptive execution splits.
    """
    rest = stage(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .filter("lo < hi")
        .distinct(),
        "edges",
    )
    found: DataFrame | None = None
    nodes = rest.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    while not rest.isEmpty():
        hooks = _to_roots(stage(rest.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks"))
        lo = hooks.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = hooks.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        ends = (
            rest.join(lo, "lo", "left")
            .join(hi, "hi", "left")
            .select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
            .filter("a <> b")
        )
        left = stage(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
        unstage(rest)
        rest = left
        if found is None:
            found = hooks
        else:
            followed = stage(_follow(found, hooks).unionByName(hooks.select("node", "root")), "found")
            unstage(found, hooks)
            found = followed
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    roots = found.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = found.select("node", "root").unionByName(roots)
    out = stage(out.select("node", F.col("root").alias("component")), "components")
    unstage(found, rest)
    return out


def _follow(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def _to_roots(hooks: DataFrame) -> DataFrame:
    while True:
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = hooks.select("node", "root").join(above, "root", "left").select(
            "node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")
        )
        moved = stage(moved, "hooks")
        unstage(hooks)
        if moved.filter("moved").isEmpty():
            return moved
        hooks = moved


# --- copies --------------------------------------------------------------------------------------

#: Words of 64 bits of the map that :func:`likely_in` broadcasts, a row each.
MAP_WORDS = 1 << 20


def likely_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is one of ``keys``, and a few others, without a shuffle of ``df``.

    A bit for each hash of a key, in a map of at most ``MAP_WORDS`` rows whatever the number of keys: with a
    million keys some 1.5 % of the other rows stay, with more than the map has bits nearly all.
    """
    place = F.xxhash64(on)
    word = F.pmod(place, F.lit(MAP_WORDS)).alias("__word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(place, 32), F.lit(64)).cast("int"))
    bits = keys.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
    marked = df.select("*", word, bit.alias("__bit")).join(F.broadcast(bits), "__word")
    return marked.filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*df.columns)



def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "left", total_share: int = 2000
) -> DataFrame:
    """Left or inner join of ``left`` with ``right``, which has one row a key, where keys of ``left`` may be hot.

    A key is hot if it holds more than 1 / ``total_share`` of the rows (and 500 at least), so there are
    fewer than ``total_share`` of them: their rows of ``right`` are broadcast. The rows of hot keys take a
    key of their own in the shuffled join, so that they spread out.
    """
    sizes = stage(left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 500"), "sizes")
    total = left.count()
    hot_keys = F.broadcast(sizes.filter(F.col("__n") > total / total_share).select(*on))
    hot = F.broadcast(right.join(hot_keys, on, "left_semi"))
    extra = [c for c in right.columns if c not in on]
    first = left.join(hot.withColumnsRenamed({c: f"__hot_{c}" for c in extra}).withColumn("__hot", F.lit(True)), on, "left")
    first = first.withColumn("__salt", F.when(F.col("__hot"), F.xxhash64(spread)).otherwise(F.lit(0).cast("bigint")))
    # a hot row finds nothing there: only salt 0 does, and a hash that is 0 finds the same row again
    rest = right.withColumn("__salt", F.lit(0).cast("bigint"))
    rest = rest.withColumn("__found", F.lit(True))
    joined = first.join(rest, [*on, "__salt"], "left")
    if how == "inner":
        joined = joined.filter("__hot or __found")
    return joined.select(*left.columns, *[F.coalesce(f"__hot_{c}", c).alias(c) for c in extra])
