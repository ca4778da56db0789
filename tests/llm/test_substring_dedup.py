"""Repeated passages: exact and near copies of paragraphs, runs inside paragraphs, clean texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from mirepoix.llm.common import MinMaxHash
from mirepoix.llm.substring_dedup import repeated_passages

DRAW = random.Random(6)


def words(n):
    return [f"w{DRAW.randrange(10**6)}" for _ in range(n)]


def table(df):
    return {(r.doc_id, r.start, r.kind): r for r in df.collect()}


def test_paragraphs(spark, documents):
    passage, other = " ".join(words(60)), " ".join(words(80))
    near = other.split()
    near[40] = "changed"
    docs = documents(
        (1, "Title\n" + passage + "\nend"), (2, passage), (3, "x\n" + passage), (4, other), (5, "a\n" + " ".join(near)),
        (6, " ".join(words(200))), (7, passage + "\n" + passage), (8, "short line\nshort line"), (9, "short line"),
        (10, "\n".join([" ".join(words(50))] * 2)),
    )
    got = {k: r for k, r in table(repeated_passages(docs)).items() if r.kind == "paragraph"}
    assert {(i, s) for i, s, _ in got} == {(1, 6), (2, 0), (3, 2), (7, 0), (7, len(passage) + 1), (4, 0), (5, 2)}
    assert {k[:2] for k, r in got.items() if r.kept} == {(1, 6), (4, 0)}
    assert all((r.first_id, r.first_start) == ((1, 6) if r.doc_id in (1, 2, 3, 7) else (4, 0)) for r in got.values())
    assert got[1, 6, "paragraph"].end == 6 + len(passage) and got[1, 6, "paragraph"].n_words == 60


def test_runs_inside_paragraphs(spark, documents):
    """50 shared words inside longer paragraphs are found, 19 are not."""
    rows = []
    for n in range(20):
        run = words(50)
        rows += [(3 * n, " ".join(words(90) + run + words(70))), (3 * n + 1, " ".join(words(5) + run + words(130)))]
        rows.append((3 * n + 2, " ".join(words(60) + run[:19] + words(60))))
    got = repeated_passages(documents(*rows)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows if i % 3 < 2}
    assert {r.first_id for r in got} == {i for i, _ in rows if i % 3 == 0}


def test_large_group_and_repeated_rows(spark, documents):
    passage = " ".join(words(60))
    rows = [(i, f"line {i}\n{passage}") for i in range(300)] + [(0, f"line 0\n{passage}")]
    got = [r for r in repeated_passages(documents(*rows)).collect() if r.kind == "paragraph"]
    assert len(got) == 301 and {r.first_id for r in got} == {0} and {r.doc_id for r in got if r.kept} == {0}


def test_edges(spark, documents):
    docs = documents((1, None), (2, ""), (3, "\n\n"), (4, " ".join(words(40_000))))
    assert repeated_passages(docs).count() == 0
    assert repeated_passages(docs.filter("doc_id > 9")).count() == 0


def test_paragraphs_equal_brute_force(spark, documents):
    """Random near copies of paragraphs: the same groups as comparing all pairs."""
    draw = random.Random(11)
    bases = [[f"b{draw.randrange(300)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(draw.randrange(1, 4)):
            line = list(draw.choice(bases))
            for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
                line[draw.randrange(60)] = f"c{draw.randrange(10**6)}"
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    places = {}
    for i, text in rows:
        start = 0
        for line in text.split("\n"):
            w = line.split()
            places[i, start] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
            start += len(line) + 1
    parent = {p: p for p in places}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in places:
        for b in places:
            if a < b and 100 * len(places[a] & places[b]) >= 80 * len(places[a] | places[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {}
    for p in places:
        groups.setdefault(root(p), []).append(p)
    want = {p: min(g) for g in groups.values() if len({d for d, _ in g}) > 1 for p in g}
    got = {(r.doc_id, r.start): (r.first_id, r.first_start) for r in repeated_passages(documents(*rows)).collect() if r.kind == "paragraph"}
    assert got == want


def test_keys_of_many_sets_equal_those_of_each():
    draw = np.random.default_rng(1)
    hashing = MinMaxHash(21, 14)
    sets = [draw.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 5, 300, 2, 700, 40, 1)]
    assert (hashing.keys_of_all(sets, 100) == np.stack([hashing.keys(s) for s in sets])).all()
    assert hashing.keys_of_all([]).shape == (0, 14)


def test_sets_are_made_of_wanted_paragraphs_only(spark, documents, monkeypatch):
    """One of two unlike paragraphs of a document has a near copy elsewhere; a row of it is repeated."""
    from mirepoix.llm import substring_dedup

    def passage(tag, n=60):
        return " ".join(f"{tag}{i}" for i in range(n))

    rows = [(7, passage("a") + "\n" + passage("b")), (7, passage("a") + "\n" + passage("b")), (8, passage("a") + " more")]
    rows += [(i, passage(f"x{i}y")) for i in range(20, 60)]
    made = []
    sets = substring_dedup.paragraph_sets
    monkeypatch.setattr(substring_dedup, "paragraph_sets", lambda *args: made.append(sets(*args)) or made[-1])
    got = {r.doc_id: r.first_id for r in repeated_passages(documents(*rows)).collect() if r.kind == "paragraph"}
    assert got == {7: 7, 8: 7}
    # both paragraphs of 7, once a row, and that of 8 before
    assert made[0].count() == 2


def test_likely_in_keeps_all_keys_and_few_others(spark):
    from mirepoix.llm.common import likely_in

    docs = spark.range(20_000).withColumnRenamed("id", "doc").withColumn("text", F.col("doc").cast("string"))
    wanted = docs.filter("doc % 10 = 3").select("doc")
    found = likely_in(docs, wanted, "doc")
    assert found.columns == docs.columns
    assert found.join(wanted, "doc").count() == 2000 and found.count() < 2100
    named = docs.select(F.col("text").alias("doc"))
    assert likely_in(named, named.limit(0), "doc").count() == 0
