"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings that labelled examples hold more often under one label than chance
allows; their document frequencies are counted over all documents. The examples are a bounded sample of
labelled rows. The index keeps for each term its postings and the largest weight in each block of examples:
blocks are visited by their upper bound until none can hold a nearer neighbour, so the neighbours are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import map_texts
from mirepoix.sources import stage

#: Labelled rows used as examples at most (half of them of each label), terms selected at most.
MOST_EXAMPLES, MOST_TERMS = 8000, 20_000
#: Rows that must hold a term, and the chi-square statistic it must reach with the label.
LEAST_ROWS, LEAST_CHI2 = 5, 30.0
#: Lengths of word beginnings.
BEGINNINGS = range(4, 9)
#: Repetitions within a text that make a term of their own: the length of a vector cannot tell them.
LEVELS = (2, 3, 5)
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are scored before the others are held against the neighbours found there.
FIRST_BLOCKS = 8
#: Vectors whose result a task remembers, as copies of a text have the same.
REMEMBERED_VECTORS = 50_000
#: Weight of the share of toxic rows in a vote, in units of similarity.
PRIOR = 0.5
CALIBRATION_BINS = 12

WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 400_000


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each one is of."""
    length = ends - starts
    of = np.repeat(np.arange(len(starts)), length)
    return np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + starts[of], of


class Index:
    """Example vectors of unit length with their labels and names.

    Postings lie one term after the other, by number of the example; an entry is a term's postings in a block of
    examples, with the largest weight among them.
    """

    def __init__(self, vectors: list[dict[int, float]], labels: np.ndarray, names: list, n_terms: int):
        #: Examples that share their heaviest term come together, so that blocks have few terms with large weights.
        self.order = sorted(range(len(vectors)), key=lambda i: max(vectors[i], key=lambda t: (vectors[i][t], t)))
        self.labels = np.asarray(labels)[self.order]
        self.names = [names[i] for i in self.order]
        self.blocks = -(-len(vectors) // BLOCK)
        postings = sorted((t, n, w) for n, i in enumerate(self.order) for t, w in vectors[i].items())
        terms = np.array([t for t, _, _ in postings], np.int64)
        self.ids = np.array([n for _, n, _ in postings], np.int64)
        self.weights = np.array([w for _, _, w in postings])
        key = terms * (self.blocks + 1) + self.ids // BLOCK
        self.starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.ends = np.append(self.starts[1:], len(key))
        self.block = self.ids[self.starts] // BLOCK
        self.tops = np.maximum.reduceat(self.weights, self.starts)
        self.entries = np.searchsorted(terms[self.starts], np.arange(n_terms + 1))

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples with a cosine above 0, ties by number.

        The blocks of the highest bounds are scored first; then, at once, all others whose bound reaches the kth
        cosine found so far. No other block can hold a nearer example.
        """
        terms = np.fromiter(query, np.int64, len(query))
        weights = np.fromiter(query.values(), float, len(query))
        entries, of = _ranges(self.entries[terms], self.entries[terms + 1])
        weights = weights[of]
        bound = np.bincount(self.block[entries], weights * self.tops[entries], self.blocks)
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        chosen = np.zeros(self.blocks, bool)
        chosen[first[bound[first] > 0]] = True
        ids, cosines = self._best(entries, weights, chosen, k, skip)
        least = cosines[-1] if len(cosines) == k else 0.0
        rest = (bound > 0) & (bound >= least - 1e-9) & ~chosen
        if rest.any():
            more = self._best(entries, weights, rest, k, skip)
            ids, cosines = np.append(ids, more[0]), np.append(cosines, more[1])
            best = np.lexsort((ids, -np.round(cosines, 12)))[:k]
            ids, cosines = ids[best], cosines[best]
        return ids, cosines

    def _best(self, entries: np.ndarray, weights: np.ndarray, chosen: np.ndarray, k: int, skip: int):
        """The ``k`` nearest examples of the chosen blocks."""
        own = chosen[self.block[entries]]
        entries, weights = entries[own], weights[own]
        at, of = _ranges(self.starts[entries], self.ends[entries])
        score = np.bincount(self.ids[at], weights[of] * self.weights[at], len(self.labels))
        if skip >= 0:
            score[skip] = 0
        ids = np.flatnonzero(score > 0)
        best = np.lexsort((ids, -np.round(score[ids], 12)))[:k]
        return ids[best], score[ids[best]]


class Model:
    """Terms with their inverse document frequencies, the index, and the calibration of its votes."""

    def __init__(self, terms: Terms, idf: np.ndarray, index: Index, prior: float):
        self.terms, self.idf, self.index, self.prior = terms, idf, index, prior
        self.bins, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def unit(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + np.log(n)) * self.idf[t] for t, n in sorted(counts.items())}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def vote(self, query: dict[int, float], skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        ids, cosines = self.index.nearest(query, NEIGHBOURS, skip)
        # near neighbours count far more than those that share one term of many
        weight = cosines**2
        toxic = float((weight * self.index.labels[ids]).sum())
        return (toxic + PRIOR * self.prior) / (float(weight.sum()) + PRIOR), ids, cosines

    def score(self, counts: dict[int, int]) -> tuple[float, list, float]:
        """Calibrated score, and as evidence the nearest examples' names and the cosine of the first."""
        query = self.unit(counts)
        if not query:
            return self.calibrated(self.prior), [], 0.0
        vote, ids, cosines = self.vote(query)
        return self.calibrated(vote), [self.index.names[i] for i in ids.tolist()], float(cosines.max(initial=0.0))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.bins, self.values))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Isotonic: the share of toxic examples in runs of votes, which pooling makes ascend.

        Votes are those of examples when they are left out; weights undo the sample's balance of labels.
        """
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # vote, toxic weight, weight
        for part in np.array_split(order, min(CALIBRATION_BINS, len(order))):
            w = weights[part]
            pools.append([float((votes[part] * w).sum()), float((labels[part] * w).sum()), float(w.sum())])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.bins = np.array([v / w for v, _, w in pools])
        self.values = np.array([min(1.0, t / w) for _, t, w in pools])


def levels_of(counts: dict[str, int]) -> Iterator[str]:
    """The terms of a text: each, and each again for the repetitions it reaches."""
    for term, n in counts.items():
        yield term
        for level in LEVELS:
            if n >= level:
                yield f"{term}@{level}"


class Terms:
    """Selected terms, numbered, and what a worker remembers of words."""

    def __init__(self, selected: list[str]):
        self.number = {t: i for i, t in enumerate(selected)}
        plain = sorted({t.partition("@")[0] for t in selected})
        self.plain = {t: i for i, t in enumerate(plain)}
        #: For each: (least count, number) of it and its levels, where selected.
        self.steps = [
            [(n, i) for n, t in ((1, p), *((n, f"{p}@{n}") for n in LEVELS)) if (i := self.number.get(t)) is not None]
            for p in plain
        ]
        self.words: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(self.number)

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each selected term occurs in the whole text."""
        if len(self.words) > _REMEMBERED:
            self.words.clear()
        words = WORD.findall((text or "").lower())
        for w in set(words).difference(self.words):
            self.words[w] = tuple(self.plain[t] for t in terms_of(w) if t in self.plain)
        found: Counter = Counter()
        for plain in filter(None, map(self.words.__getitem__, words)):
            found.update(plain)
        return {i: n for p, n in found.items() for least, i in self.steps[p] if n >= least}

    def __reduce__(self):
        return Terms, (list(self.number),)


def _document_frequencies(vectors: DataFrame, n_terms: int) -> DataFrame:
    """``(t, n)``: documents that hold each term; a task sends its sums, one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["t", "n"])

    return vectors.select("terms").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    most_examples: int = MOST_EXAMPLES,
    most_terms: int = MOST_TERMS,
) -> tuple[Model | None, DataFrame]:
    """The model, and ``(id, counts, ...)`` of the selected terms of every document.

    ``labels`` are the rows that may be learnt from. None instead of a model if there is not an example of
    each label that holds a selected term.
    """
    labels = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    sizes = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    half = most_examples // 2
    chosen = [labels.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(half) for y in (0, 1)]
    # bounded by most_examples rows
    examples = F.broadcast(stage(chosen[0].unionByName(chosen[1]).withColumnRenamed(id_col, "id"), "examples"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def all_terms(texts: list) -> Iterator[tuple]:
        for text in texts:
            found = Counter(t for w in WORD.findall((text or "").lower()) for t in terms_of(w))
            yield (list(levels_of(found)),)

    held = map_texts(source.join(examples, "id"), "text", ["y"], all_terms, "terms array<string>")
    n1 = min(half, sizes.get(1, 0))
    n0 = min(half, sizes.get(0, 0))
    held = held.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    expected = F.col("n") * (n1 / max(1, n0 + n1))
    # against the other rows the statistic adds the same difference over their expectation
    chi2 = F.pow(F.col("toxic") - expected, 2) * (1 / expected + 1 / (F.col("n") - expected))
    held = held.filter((F.col("n") >= LEAST_ROWS) & (chi2 >= LEAST_CHI2))
    chosen_terms = held.orderBy(chi2.desc(), "term").limit(most_terms).select("term").collect() if n0 and n1 else []
    terms = Terms([r["term"] for r in chosen_terms])

    def selected(texts: list) -> Iterator[tuple]:
        for text in texts:
            counts = terms.counts(text)
            yield list(counts), list(counts.values())

    vectors = stage(map_texts(source, "text", ["id"], selected, "terms array<int>, counts array<int>"), "term_counts")
    if not len(terms):
        return None, vectors
    total = vectors.count()
    df = np.zeros(len(terms))
    for r in _document_frequencies(vectors, len(terms)).collect():  # at most ``most_terms`` rows
        df[r["t"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = vectors.join(examples, "id").filter("size(terms) > 0").orderBy("id").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None, vectors
    # every example stands for as many labelled rows as the sample thinned its label by
    stands = {1: sizes[1] / n1, 0: sizes[0] / n0}
    model = Model(terms, idf, None, sizes[1] / (sizes[0] + sizes[1]))
    units = [model.unit(dict(zip(r["terms"], r["counts"], strict=True))) for r in rows]
    model.index = Index(units, y, [r["id"] for r in rows], len(terms))
    order = model.index.order
    votes = np.array([model.vote(units[i], skip=n)[0] for n, i in enumerate(order)])
    # examples without a selected term vote with the prior
    empty = {1: n1 - y.sum(), 0: n0 - (len(y) - y.sum())}
    votes = np.append(votes, [model.prior, model.prior])
    found = np.append(y[order], [1.0, 0.0])
    weights = np.append([stands[int(v)] for v in y[order]], [stands[1] * empty[1], stands[0] * empty[0]])
    model.calibrate(votes[weights > 0], found[weights > 0], weights[weights > 0])
    return model, vectors


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
) -> DataFrame:
    """``(id_col, score, predicted, n_neighbours, nearest, neighbours)``, one row a document: ``neighbours`` are the ids
    of the nearest examples, the nearest first, and ``nearest`` its cosine.

    ``labels`` holds the rows to learn from; null ids and labels and other values than 0 and 1 are left out, of
    repeated ids the larger label counts. Null and empty texts, and texts without a selected term, get the
    calibrated share of toxic rows; if nothing can be learnt, all texts get that share as it is (0 without labels).
    Other columns are ignored.
    """
    model, vectors = fit(docs, labels, id_col, text_col, label_col)
    share = 0.0 if model else _share(labels, id_col, label_col)

    def run(frames):
        known: dict[tuple, tuple] = {}
        for frame in frames:
            found = []
            for terms, counts in zip(frame["terms"], frame["counts"], strict=True):
                key = terms.tobytes(), counts.tobytes()
                if key not in known:
                    if len(known) >= REMEMBERED_VECTORS:
                        known.clear()
                    counted = dict(zip(terms.tolist(), counts.tolist(), strict=True))
                    known[key] = model.score(counted) if model else (share, [], 0.0)
                found.append(known[key])
            frame["score"], frame["neighbours"], frame["nearest"] = [list(c) for c in zip(*found, strict=True)] if found else ([], [], [])
            yield frame[["id", "score", "neighbours", "nearest"]]

    kind = vectors.schema["id"].dataType.simpleString()
    scored = vectors.mapInPandas(run, f"id {kind}, score double, neighbours array<{kind}>, nearest double")
    return scored.select(
        F.col("id").alias(id_col),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("neighbours").alias("n_neighbours"),
        "nearest",
        "neighbours",
    )


def _share(labels: DataFrame, id_col: str, label_col: str) -> float:
    """Share of toxic ones among labelled rows, 0 if there are none."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    return float(known.agg(F.avg("y")).head()[0] or 0.0)
