"""Links of vectors against a full comparison: recall of the index, no false link, edge cases."""

import math

import numpy as np
import pytest

from mirepoix.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, id int"


def brute_force(rows):
    """(links by id, components) with cosines in double precision."""
    ok = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for n, (a, x, y) in enumerate(ok):
        for b, z, w in ok[n + 1 :]:
            if y == w and len(x) == len(z) and x @ z / math.sqrt((x @ x) * (z @ z)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    return links


def table(spark, rows):
    made = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA)
    return {r.vec_id: r for r in near_vectors(made).collect()}


def test_recall_and_precision(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(250, 32))
    near = [b + draw.normal(size=32) * s for b in base for s in (0.02, 0.1)]
    vectors = np.concatenate([base, near, base[:40] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i % 5 else 0) for i, v in enumerate(vectors)]
    want = brute_force(rows)
    got = table(spark, rows)
    total = sum(map(len, want.values()))
    assert got.keys() == want.keys() and total > 100
    assert all(got[i].n_links <= len(want[i]) for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * total
    reach = smallest_reachable(want)
    assert all(got[i].component_id >= reach[i] for i in want)


def smallest_reachable(links):
    out = {}
    for start in sorted(links):
        left = [start] if start not in out else []
        while left:
            i = left.pop()
            if i not in out:
                out[i] = start
                left += links[i]
    return out


@pytest.mark.parametrize("dim", [8, 64])
def test_recall_at_the_threshold(spark, dim):
    """Pairs of cosine 0.981, and a group of near copies that holds a third of all rows."""
    draw = np.random.default_rng(2)
    base = draw.normal(size=(400, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = draw.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    close = 0.981 * base + math.sqrt(1 - 0.981**2) * away
    around = draw.normal(size=dim) + 0.1 * draw.normal(size=(400, dim))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, close, around]).astype(np.float32))]
    want, got = brute_force(rows), table(spark, rows)
    assert all(got[i].n_links <= len(want[i]) for i in want)
    apart = [i for i in want if i < 800]
    assert sum(got[i].n_links for i in apart) >= 0.9 * sum(len(want[i]) for i in apart) > 300
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, want.values()))


def test_blocks_count_a_pair_once(spark, monkeypatch):
    monkeypatch.setattr("mirepoix.llm.embedding_dedup.BLOCK", 7)
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=16) + 0.02 * draw.normal(size=(60, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors.astype(np.float32))]
    want = brute_force(rows)
    got = table(spark, rows)
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert {i: r.component_id for i, r in got.items()} == smallest_reachable(want)



def test_copies_count_their_links(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(30)] + [(i, [2.0, 4.0, 6.0], 1) for i in range(30, 40)] + [(50, [1.0, 2.0, 3.0], 2)]
    got = table(spark, rows)
    assert all(got[i].n_links == 39 and got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(40))
    assert (got[50].n_links, got[50].component_id, got[50].kept) == (0, 50, True)


@pytest.mark.parametrize("bad", [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0]])
def test_unusable_vectors_link_with_nothing(spark, bad):
    rows = [(1, bad, 1), (2, bad, 1), (3, [1.0, 1.0], None), (4, [1.0, 1.0], None), (5, [1e-30, 1e-30], 1), (6, [1e30, 1e30], 1)]
    got = table(spark, rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {
        1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5),
    }


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
