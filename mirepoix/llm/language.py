"""Language identification: a blended-spectrum presence kernel with Nyström landmarks and one-versus-rest
kernel ridge regression.

The kernel of two texts is the number of character n-grams (1 to 4) that both contain, over the geometric
mean of the numbers each contains. Its feature map on a bounded set of landmark texts is a matrix product,
and so is the scoring of a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import map_texts

#: Labelled texts the model is fitted on at most, landmarks among them, and buckets n-grams are hashed to.
MOST_ROWS, LANDMARKS, BUCKETS = 4000, 256, 1 << 14
NGRAMS = 4
RIDGE = 1e-3
UNDETERMINED = "und"
#: Texts in a matrix product.
BATCH = 256
_STRETCH = 1 << 20


def presence(text: str, into: np.ndarray) -> None:
    """Marks the buckets of the n-grams of the lower-cased text, words parted by single spaces, in ``into``."""
    spaced = f" {' '.join(text.lower().split())} "
    points = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # stretches overlap by an n-gram, so that memory stays bounded and nothing is left out
    for i in range(0, len(points), _STRETCH):
        part = points[i : i + _STRETCH + NGRAMS - 1]
        code = np.zeros(len(part), np.uint64)
        for n in range(NGRAMS):
            code = code[: len(part) - n] * np.uint64(0x100000001B3) + part[n:] + np.uint64(1)
            into[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Landmark matrix and one weight vector a language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, sharpness: float):
        self.languages, self.weights, self.sharpness = languages, weights, sharpness
        self.landmarks = landmarks.T.astype(np.float32)
        self.norms = np.sqrt(landmarks.sum(axis=1))

    def kernel(self, marks: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))
        return (marks.astype(np.float32) @ self.landmarks) / own[:, None] / self.norms[None, :]

    def predict(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its share of the softmax of the margins."""
        margins = (self.kernel(marks) @ self.weights[:-1] + self.weights[-1]) * self.sharpness
        odds = np.exp(margins - margins.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        return best, odds[np.arange(len(best)), best] / odds.sum(axis=1)


def sample(labelled: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` rows by hash, about equally many of each label: every label keeps its share of the
    bound or all its rows. Labels are counted over all rows; they are assumed to be few."""
    counts = {r[label_col]: r["count"] for r in labelled.groupBy(label_col).count().collect()}
    if not counts:
        return labelled.limit(0)
    share = most / len(counts)
    kept: Column = F.lit(0.0)
    for label, n in sorted(counts.items(), key=lambda x: str(x[0])):
        kept = F.when(F.col(label_col) == label, min(1.0, share / n)).otherwise(kept)
    fraction = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)
    return labelled.filter(fraction < kept).orderBy(F.xxhash64(id_col), id_col).limit(most)


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, most: int = MOST_ROWS) -> Model | None:
    """The model of a bounded sample of labelled rows; None if no labelled row holds a letter.

    Texts of the sample are turned into packed n-gram marks by the tasks, 2 KB each whatever their length.
    """

    def rows(texts: list) -> Iterator[tuple]:
        for text in texts:
            mark = np.zeros(BUCKETS, np.uint8)
            if has_letter(text):
                presence(text, mark)
            yield (np.packbits(mark).tobytes(),)

    chosen = sample(labelled.select(id_col, text_col, label_col), id_col, label_col, most)
    marked = map_texts(chosen, text_col, [label_col], rows, "marks binary").collect()
    marks = np.array([np.unpackbits(np.frombuffer(r["marks"], np.uint8)) for r in marked]).reshape(-1, BUCKETS)
    labels = np.array([r[label_col] for r in marked], dtype=object)
    usable = marks.any(axis=1) if len(marks) else np.zeros(0, bool)
    marks, labels = marks[usable], labels[usable]
    if not len(marks):
        return None
    languages = sorted(set(labels))
    order = np.lexsort((np.arange(len(labels)), _turn(labels)))
    landmarks = marks[order[:LANDMARKS]]
    model = Model(languages, landmarks, np.zeros((len(landmarks) + 1, len(languages))), 1.0)
    features = np.concatenate([model.kernel(part) for part in np.array_split(marks, max(1, len(marks) // 512))])
    # Nyström: ridge regression in the landmarks' feature space has the kernel of the landmarks as its norm
    target = np.where(labels[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    within = model.kernel(landmarks)
    mean = features.mean(axis=0)
    centred = features - mean
    grams = centred.T @ centred + RIDGE * len(marks) * (within + 1e-6 * np.eye(len(within)))
    weights = np.linalg.solve(grams, centred.T @ (target - target.mean(axis=0)))
    bias = target.mean(axis=0) - mean @ weights
    model.weights = np.vstack([weights, bias])
    model.sharpness = 4.0
    return model


def _turn(labels: np.ndarray) -> np.ndarray:
    """The number of rows of the same label before each, so that landmarks take labels in turn."""
    seen: dict = {}
    out = np.empty(len(labels), np.int64)
    for i, label in enumerate(labels):
        out[i] = seen[label] = seen.get(label, -1) + 1
    return out


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    Whole texts are scored. Null texts and texts without a letter are ``und`` with score 0; without a model
    all texts are. All other columns and repeated rows are kept.
    """

    def rows(texts: list) -> Iterator[tuple]:
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            usable = [model is not None and has_letter(t) for t in part]
            marks = np.zeros((sum(usable), BUCKETS), np.uint8)
            for mark, text in zip(marks, (t for t, u in zip(part, usable, strict=True) if u), strict=True):
                presence(text, mark)
            found = iter(zip(*model.predict(marks), strict=True)) if len(marks) else iter(())
            for u in usable:
                if u:
                    best, score = next(found)
                    yield model.languages[best], float(min(1.0, max(0.0, score)))
                else:
                    yield UNDETERMINED, 0.0

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return map_texts(docs, text_col, names, rows, "lang_pred string, score double")
