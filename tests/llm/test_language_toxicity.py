"""Held-out accuracy, exactness of the neighbour index, edge cases."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from mirepoix.llm import queries
from mirepoix.llm import toxicity as module
from mirepoix.llm.language import fit, with_language
from mirepoix.llm.toxicity import Index, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    found = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    found = found.filter("held_out and lang is not null and length(text) > 0").toPandas()
    assert len(found) > 100 and (found.lang_pred == found.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_edges(spark, documents):
    rows = [(i, t) for i, t in enumerate(["the house and the garden", "das haus und der garten"] * 4)]
    labelled = documents(*rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = fit(labelled, "doc_id", "text", "lang")
    asked = documents((1, None), (2, ""), (3, "123 !?"), (4, "the garden " * 30_000), (5, "und der garten"), (5, "und der garten"))
    got = sorted((r.doc_id, r.lang_pred) for r in with_language(asked, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert fit(labelled.filter("doc_id < 0"), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in with_language(asked, None).collect()} == {"und"}
    assert with_language(asked.filter("doc_id > 9"), model).count() == 0


def test_toxicity_held_out(spark):
    found = queries.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = found[found.held_out & found.toxic.notna()]
    assert held.score.between(0, 1).all()
    right = (held.predicted == 1) & (held.toxic == 1)
    assert right.sum() >= 0.9 * (held.predicted == 1).sum() and right.sum() >= 0.6 * (held.toxic == 1).sum()


def test_nearest_examples_are_exact():
    """The block-max search gives the similarities of a full comparison."""
    draw = random.Random(4)
    vectors = []
    for _ in range(700):
        v = {t: draw.random() for t in draw.sample(range(80), draw.randrange(1, 9))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    index = Index(vectors, np.array([i % 2 for i in range(700)], float), list(range(700)), 80)
    same = {3: 1.0}
    for query in [*vectors[:60], same]:
        want = sorted((sum(w * v.get(t, 0.0) for t, w in query.items()) for v in vectors), reverse=True)[:15]
        got = index.nearest(query, 15)
        similar = next(x for x in got if np.asarray(x).dtype.kind == "f")
        assert sorted(similar, reverse=True) == pytest.approx([w for w in want if w > 0][: len(similar)])
        assert len(similar) == len([w for w in want if w > 0])


def test_equal_examples_and_left_out_ones():
    """All bounds are equal, so every block is scored; ties go by number and the left-out example is not found."""
    index = Index([{0: 0.6, 1: 0.8}] * 300, np.ones(300), [f"d{i}" for i in range(300)], 2)
    ids, cosines = index.nearest({0: 0.6, 1: 0.8}, 5, skip=2)
    assert ids.tolist() == [0, 1, 3, 4, 5] and cosines == pytest.approx([1.0] * 5)
    assert [index.names[i] for i in ids] == ["d0", "d1", "d3", "d4", "d5"]


def test_scores_equal_a_full_vote(spark, documents, monkeypatch):
    """Scores and evidence against cosines of all examples, with every term selected."""
    monkeypatch.setattr(module, "LEAST_CHI2", 0.0)
    monkeypatch.setattr(module, "LEAST_ROWS", 1)
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["vile", "mean", "kind", "calm", "blue", "stone"][(i % 2) * 2 :][:4]) for _ in range(9))) for i in range(60)]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    model, vectors = module.fit(docs, labels, "doc_id", "text", "toxic")
    units = {r.id: model.unit(dict(zip(r.terms, r.counts, strict=True))) for r in vectors.collect()}
    for r in toxicity(docs, labels).collect():
        cosines = {e: sum(w * units[e].get(t, 0.0) for t, w in units[r.doc_id].items()) for e in range(40) if units[e]}
        near = sorted((c for c in cosines.values() if c > 0), reverse=True)[:15]
        assert [cosines[e] for e in r.neighbours] == pytest.approx(near)
        weight = [cosines[e] ** 2 for e in r.neighbours]
        toxic = sum(w * (e % 2) for w, e in zip(weight, r.neighbours, strict=True))
        vote = (toxic + module.PRIOR * model.prior) / (sum(weight) + module.PRIOR)
        assert r.score == pytest.approx(model.calibrated(vote))
        assert r.n_neighbours == len(near) and r.nearest == pytest.approx(max(near, default=0))


def test_toxicity_edges(spark, documents):
    docs = documents((1, None), (2, ""), (3, "hello"), (4, "a " * 100_000))
    labels = spark.createDataFrame([(3, 1), (3, None), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got.values())
    assert {r.score for r in got.values()} == {0.5} and all(r.neighbours == [] for r in got.values())
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.filter("doc_id > 9"), labels).count() == 0
