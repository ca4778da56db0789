"""Hard negatives by Fagin's threshold algorithm on integer inner products.

Vectors become whole numbers, so that scores are exact and ties are ties. Anchors (a stated set of queries) are
searched for against all rows, a bounded wave of anchors at a time: a wave travels to the tasks, the rows stay where
they are read and are not shuffled. A task turns each batch of its rows into a shard with one list a dimension,
sorted by component. An anchor reads these lists from the end its component's sign asks for, scores each row met by
random access, and stops when the threshold (what the last rows read would score, taken together) falls strictly
below the kth score of each of its windows. Tasks return a few rows an anchor; a ranking over them ends the search.

There are two searches: the nearest rows of the anchor's label (its positives), then the windows that their scores
open below them among the rows of other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirepoix.sources import stage

#: Anchors that travel to the tasks together: about 10 MB at 64 components.
WAVE = 20_000
#: Rows read from each list in the first round; a round reads twice as many as the one before.
FIRST_ROUND = 16
#: Sums of products below this are exact in floating point, which multiplies matrices faster.
EXACT = 2**53
MOST = np.iinfo(np.int64).max
LEAST = -MOST


class Shard:
    """Rows of equal length with their lists by component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self.most = int(np.abs(x).max(initial=0))
        self.x = x
        self.floats = x.astype(np.float64) if x.shape[1] * self.most < EXACT else None
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.values = np.take_along_axis(x, self.order.T, axis=0).T

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.floats is not None and int(np.abs(anchor).max(initial=0)) * self.most * len(anchor) < EXACT:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor


@dataclass
class Anchor:
    """A query, the windows of scores it asks for, and what a task has found for it so far."""

    id: int
    label: object
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def take(self, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Keeps the first ``k`` of each window; the kth score of each, ``LEAST`` where there are fewer."""
        useful = (scores >= self.low.min()) & (scores <= self.high.max())
        scores, ids = np.append(self.scores, scores[useful]), np.append(self.ids, ids[useful])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        first = np.searchsorted(-scores, -self.high)
        end = np.searchsorted(-scores, -self.low, side="right")
        kept = np.zeros(len(scores), bool)
        for a, b in zip(first, np.minimum(end, first + k), strict=True):
            kept[a:b] = True
        kth = np.full(len(first), LEAST)
        full = first + k <= end
        kth[full] = scores[first[full] + k - 1]
        self.scores, self.ids = scores[kept], ids[kept]
        return kth


def search(shard: Shard, anchor: Anchor, allowed: np.ndarray, k: int) -> int:
    """Adds the shard's rows to what ``anchor`` has found; the number of rows scored."""
    n = len(shard.ids)
    up, down = np.flatnonzero(anchor.x > 0), np.flatnonzero(anchor.x < 0)
    if not len(up) and not len(down):  # every row scores 0
        rows = np.flatnonzero(allowed)
        anchor.take(np.zeros(len(rows), np.int64), shard.ids[rows], k)
        return len(rows)
    seen = np.zeros(n, bool)
    depth, step, scored = 0, FIRST_ROUND, 0
    while depth < n:
        end = min(n, depth + step)
        step *= 2
        met = np.zeros(n, bool)
        met[shard.order[up, n - end : n - depth]] = True
        met[shard.order[down, depth:end]] = True
        met &= ~seen
        seen |= met
        rows = np.flatnonzero(met & allowed)
        scored += len(rows)
        kth = anchor.take(shard.scores(rows, anchor.x), shard.ids[rows], k)
        threshold = int(shard.values[up, n - end] @ anchor.x[up]) + int(shard.values[down, end - 1] @ anchor.x[down])
        # rows not met score the threshold at most; at a tie the smaller id might be among them
        if ((kth > threshold) | (anchor.low > threshold) | (anchor.low > anchor.high)).all():
            break
        depth = end
    return scored


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and components of the rows of each length."""
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    vectors = batch.column(2)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield ids[rows], labels[rows], x.astype(np.int64, copy=False).reshape(len(rows), dim)


def _searched(rows: DataFrame, anchors: list[tuple], same_label: bool, k: int) -> DataFrame:
    """``(anchor, id, score)``: a superset of the first ``k`` rows of each window, few a task and anchor.

    ``anchors`` are tuples (id, label, components, least and most scores of the windows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [
            Anchor(i, label, np.array(x, np.int64), np.array(low, np.int64), np.array(high, np.int64))
            for i, label, x, low, high in anchors
        ]
        groups: dict[tuple, list[Anchor]] = {}
        for a in own:
            groups.setdefault((len(a.x), a.label if same_label else None), []).append(a)
        for batch in batches:
            for ids, labels, x in _shards(batch):
                if same_label:
                    for label in set(labels.tolist()):
                        if wanted := groups.get((x.shape[1], label)):
                            at = labels == label
                            shard = Shard(ids[at], labels[at], x[at])
                            for a in wanted:
                                search(shard, a, shard.ids != a.id, k)
                elif wanted := groups.get((x.shape[1], None)):
                    shard = Shard(ids, labels, x)
                    other = {label: labels != label for label in {a.label for a in wanted}}
                    for a in wanted:
                        search(shard, a, other[a.label], k)
        some = [a for a in own if len(a.ids)]
        if some:
            counts = [len(a.ids) for a in some]
            columns = np.repeat([a.id for a in some], counts), *(np.concatenate([getattr(a, c) for a in some]) for c in ("ids", "scores"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor bigint, id bigint, score bigint")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    wave: int = WAVE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor and each of its
    first ``positives`` other rows of the same label, the first ``negatives`` rows of another label whose score is
    from ``low_percent`` to ``high_percent`` per cent of the positive's. Higher scores come first, ties by smaller id.

    A component x counts as ``floor(scale * x)``, a score is the inner product of such numbers and must fit into 64
    bits. ``anchors`` turns the id column into the condition of being an anchor. Ids are whole numbers. Rows with a
    null id, label or vector or a null or non-finite component take no part; rows of another length than the anchor's
    are not compared with it. A negative score of a positive opens an empty window. Of repeated ids every row is
    a candidate, and the one with the smallest label and vector is the anchor; rows with the anchor's id are not its
    positives. Anchors without positives or negatives have no rows, an empty table gives none. Other columns are
    ignored, whatever their names.
    """
    v = F.col(f"`{vector_col}`")
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").alias("label"), whole.alias("x"), finite.alias("finite"))
    rows = stage(rows.filter("id is not null and label is not null and finite").drop("finite"), "vectors")

    asked = rows.filter(anchors(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "x")).alias("own"))
    asked = stage(asked.select("id", "own.label", "own.x"), "anchors")
    waves = -(-asked.count() // wave)
    found = None
    for n in range(waves):
        # about ``wave`` rows, whatever the number of anchors
        now = asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == n).collect()
        rows_of_wave = _wave(rows, now, positives, negatives, low_percent, high_percent)
        rows_of_wave = stage(rows_of_wave, "negatives") if waves > 1 else rows_of_wave
        found = rows_of_wave if found is None else found.unionByName(rows_of_wave)
    if found is None:
        kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return vectors.sparkSession.createDataFrame([], kinds)
    return found


def _wave(rows: DataFrame, anchors: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    everything = [LEAST], [MOST]
    near = _searched(rows, [(a.id, a.label, a.x, *everything) for a in anchors], True, positives)
    # a repeated id is several positives, told apart by their place
    near = _ranked(near, ["anchor"], positives).withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    near = stage(near.withColumnRenamed("rank", "place"), "positives")
    scores: dict[int, set[int]] = {}
    for r in near.select("anchor", "positive_score").collect():
        scores.setdefault(r[0], set()).add(r[1])

    def windows(of: set[int]) -> tuple[list[int], list[int]]:
        at = sorted(of)
        return [-(-low * s // 100) for s in at], [high * s // 100 for s in at]

    asked = [(a.id, a.label, a.x, *windows(scores[a.id])) for a in anchors if a.id in scores]
    far = _searched(rows, asked, False, negatives).join(near, "anchor")
    score = F.col("score")
    far = far.filter((low * F.col("positive_score") <= 100 * score) & (100 * score <= high * F.col("positive_score")))
    return _ranked(far, ["anchor", "place"], negatives).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
