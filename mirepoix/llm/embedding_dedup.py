"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors, no two of which would link. A vector is described by its nearest
pivots. Two vectors are candidates if they share enough of them, and only candidates are verified, by cosine in
double precision. Of vectors that share ``SHARED`` of ``LISTED`` pivots, two shared ones stand among the first
``LISTED - SHARED + 2`` of each, in the order of pivot numbers: the inverted lists are therefore those of pairs of
pivots, which stay short where lists of single pivots grow. Lists first hold ids and pivots only, to count what is
shared; vectors are brought to the entries that have a candidate. Lists are cut into blocks and blocks meet in pairs,
so a list of any length is spread over tasks; a pair counts in the list of its first two shared pivots only, and tasks
return entries, sums and local components, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import components, spread_join
from mirepoix.sources import stage, unstage

#: Bounds of the number of pivots and of their bytes; between them it is ``PIVOTS`` times the root of the number of vectors.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 64, 65_536, 64_000_000
PIVOTS = 8
#: Pivots that describe a vector, and how many of them candidates share.
LISTED, SHARED = 12, 5
#: Vectors in a block of a list, and comparisons of pivots done at once.
BLOCK, AT_ONCE = 512, 4_000_000
#: What names a list, and a pair of its blocks.
LIST = ["dim", "label", "one", "two"]
PART = [*LIST, "block", "other"]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, which no square then overflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    most_pivots: int = MOST_PIVOTS,
    listed: int = LISTED,
    shared: int = SHARED,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row a vector.

    Vectors are compared when their labels are equal and they have equally many components; a link is a cosine
    of ``threshold`` or more. Vectors with a null label, null or zero vectors and ones with a null or
    non-finite component link with nothing. Ids are unique; other columns are ignored; an empty table gives an
    empty result. Candidates share ``shared`` (2 at least) of ``listed`` pivots, or all where there are fewer pivots;
    every candidate of the threshold is a link. The recall is measured in the tests.
    """
    v = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.withColumn("usable", F.coalesce(_usable(F.col("v")) & F.col("label").isNotNull(), F.lit(False)))
    keys = {"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(2), "v", "label")}
    rows = stage(rows.withColumns(keys), "vectors")
    usable = rows.filter("usable")
    classes = usable.groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = stage(classes.withColumn("dim", F.size("v")), "classes")

    n = classes.count()
    sample = min(most_pivots, max(LEAST_PIVOTS, math.ceil(PIVOTS * math.sqrt(n))))
    pivots = _pivots(classes, sample, threshold)
    nearest = classes.select("rep", "v", "dim").mapInPandas(_describe(pivots, listed), "rep bigint, nearest array<int>")
    nearest = stage(classes.select("rep", "label", "dim").join(nearest, "rep"), "nearest")
    first = F.slice("nearest", 1, F.greatest(F.size("nearest") - shared, F.lit(0)) + 2)
    entries = nearest.withColumn("first", first).withColumn("pair", F.explode(_pairs(F.col("first"))))
    entries = entries.select("rep", "label", "dim", "nearest", F.col("pair.one").alias("one"), F.col("pair.two").alias("two"))
    lists = entries.groupBy(*LIST).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = entries.join(lists.select(*LIST, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), LIST)
    # a row meets the other block of each pair of blocks its own is in
    entries = entries.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumns({"block": F.least("own", "meets"), "other": F.greatest("own", "meets")})
    described = f"rep bigint, own int, nearest array<int>, {_PART_SCHEMA}"
    near = stage(_by_list(entries.select("rep", "own", "nearest", *PART), _with_candidates(shared), described), "candidates")
    compared = near.join(classes.select("rep", "copies", "v"), "rep")
    found = stage(_by_list(compared, _verified(threshold, shared), "rep bigint, links bigint, root bigint"), "found")
    unstage(near, nearest)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("k1", "k2", "rep", "copies")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = spread_join(usable.select("id", "k1", "k2"), stage(named, "named"), ["k1", "k2"], "id")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )


def _pairs(pivots: Column) -> Column:
    pair = lambda x, y: F.struct(x.alias("one"), y.alias("two"))
    return F.flatten(F.transform(pivots, lambda x, i: F.transform(F.slice(pivots, i + 2, F.size(pivots)), lambda y: pair(x, y))))


def _pivots(classes: DataFrame, n: int, apart: float) -> dict[int, np.ndarray]:
    """Up to ``n`` vectors by the hash of their id, stacked by their number of components; those that have a cosine
    of ``apart`` or more with one taken before are left out, as a dense place would take all pivots for itself."""
    width = max(classes.agg(F.max("dim")).first()[0] or 1, 1)
    n = min(n, max(LEAST_PIVOTS, PIVOT_BYTES // (8 * width)))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(n).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    return {d: _apart(unit(pd.Series(vs)), apart) for d, vs in by_dim.items()}


def _apart(x: np.ndarray, apart: float) -> np.ndarray:
    kept, n = np.empty_like(x), 0
    for row in x:
        if not n or (kept[:n] @ row).max() < apart:
            kept[n] = row
            n += 1
    return kept[:n].copy()


def _describe(pivots: dict[int, np.ndarray], listed: int):
    """The numbers of the nearest pivots, ascending; two numbers below 0 or one where there are fewer than two pivots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, rows in frame.groupby("dim"):
                own = pivots.get(dim, np.empty((0, dim)))
                none = np.tile(np.arange(min(0, len(own) - 2), 0), (len(rows), 1))
                parts = []
                for i in range(0, len(rows), 1024):
                    near = unit(rows["v"].iloc[i : i + 1024]) @ own.T
                    parts.append(np.argsort(-near, axis=1, kind="stable")[:, :listed])
                nearest = np.sort(np.concatenate([none, np.concatenate(parts)], axis=1), axis=1).astype(np.int32)
                yield pd.DataFrame({"rep": rows["rep"].to_numpy(), "nearest": list(nearest)})

    return run


_PART_SCHEMA = "dim int, label {label}, one int, two int, block int, other int"


def _by_list(entries: DataFrame, result: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``result`` makes of the rows of each pair of blocks; there are many small ones, so rows come sorted and
    are cut into runs, of which the last of a batch waits for the next batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            starts = _starts(rows)
            out = [result(rows.iloc[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            rest = rows.iloc[starts[-1] :]
            yield from _filled(out)
        if rest is not None:
            yield from _filled([result(rest)])

    schema = schema.format(label=entries.schema["label"].dataType.simpleString())
    return entries.repartition(*PART).sortWithinPartitions(*PART).mapInPandas(run, schema)


def _starts(rows: pd.DataFrame) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in PART:
        column = rows[c].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _filled(made: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made = [m for m in made if len(m)]
    if made:
        yield pd.concat(made, ignore_index=True)


def _candidates(rows: pd.DataFrame, shared: int) -> np.ndarray:
    """Which rows of a pair of blocks share enough pivots, and have this list as their first."""
    nearest = np.stack(rows["nearest"].to_numpy())
    m, listed = nearest.shape
    least, second = min(shared, listed), rows["two"].iat[0]
    out = np.zeros((m, m), bool)
    step = max(1, AT_ONCE // (m * listed * listed))
    for i in range(0, m, step):
        part = nearest[i : i + step]
        common = (part[:, None, :, None] == nearest[None, :, None, :]).any(axis=3)
        # both hold the list's two pivots: no other shared one may stand before the second
        earlier = (common & (part < second)[:, None, :]).sum(axis=2)
        out[i : i + step] = (common.sum(axis=2) >= least) & (earlier == 1)
    np.fill_diagonal(out, False)
    if rows["block"].iat[0] != rows["other"].iat[0]:
        own = rows["own"].to_numpy()
        out &= own[:, None] != own[None, :]
    return out


def _with_candidates(shared: int):
    def result(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return rows.iloc[:0]
        return rows[_candidates(rows, shared).any(axis=1)]

    return result


def _verified(threshold: float, shared: int):
    """Links of each row, weighted by copies, and the smallest row it reaches in this pair of blocks."""

    def result(rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(rows["v"])
        near = _candidates(rows, shared) & (x @ x.T >= threshold)
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
        ids, copies = rows["rep"].to_numpy()[some], rows["copies"].to_numpy()[some]
        links = near @ copies
        root, most = ids.copy(), np.iinfo(np.int64).max
        while True:
            lower = np.minimum(root, np.where(near, root[None, :], most).min(axis=1, initial=most))
            if (lower == root).all():
                break
            root = lower
        return pd.DataFrame({"rep": ids, "links": links, "root": root})

    return result
