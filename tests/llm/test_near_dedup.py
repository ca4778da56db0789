"""Near copies of documents against brute force: links, components, edge cases."""

import itertools
import random

import numpy as np
import pytest

from mirepoix.llm import near_dedup
from mirepoix.llm.common import components
from mirepoix.llm.near_dedup import near_duplicates


def shingle_set(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_force(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def table(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"w{draw.randrange(500)}"
    return words


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, documents, k):
    draw = random.Random(k)
    rows = []
    for _ in range(25):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.choice([3, 30, 90]))]
        for _ in range(draw.choice([1, 2, 5])):
            rows.append(" ".join(edited(words, draw.choice([0, 1, 2, 3, 6]), draw)))
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    assert table(near_duplicates(documents(*rows), shingle_words=k)) == brute_force(rows, k)


def test_large_group_of_near_copies(spark, documents):
    """More members than a small bucket, a chain among them, and many exact copies."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = [" ".join(edited(words, draw.randrange(4), draw)) for _ in range(70)] + [" ".join(words)] * 50
    rows = list(enumerate(rows))
    assert table(near_duplicates(documents(*rows))) == brute_force(rows, 5)


def test_edges(spark, documents):
    """No words: no link. Fewer words than a shingle: one shingle. Case of A-Z only is ignored."""
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(9, None), (3, ""), (4, " \t\n"), (5, "One two"), (1, "one\ftwo"), (6, "É b c"), (7, "é b c"), (8, long), (2, long)]
    assert table(near_duplicates(documents(*rows))) == {
        9: (0, 9), 3: (0, 3), 4: (0, 4), 5: (1, 1), 1: (1, 1), 6: (1, 6), 7: (1, 7), 8: (5000, 2), 2: (5000, 2),
    }


def test_empty_table(spark, documents):
    df = near_duplicates(documents((1, "a")).filter("doc_id > 1"))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"] and df.count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (401, 400), (400, 401)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {400: 400, 401: 400}
    assert {n: c for n, c in got.items() if n != 300} == want


def test_one_bucket_of_unlike_members(spark, monkeypatch):
    """2,000 members that share a bucket and nothing else but a few close pairs: verified pairs stay in proportion."""
    draw = random.Random(5)
    sets = [sorted(draw.sample(range(10**9), 40)) for _ in range(1900)]
    sets += [sorted([*s[:38], 10**9 + i]) for i, s in enumerate(sets[:100])]
    order = list(range(2000))
    draw.shuffle(order)
    rows = [(i, 40 if n < 1900 else 39, [77, 1000 + i], sets[n]) for i, n in enumerate(order)]
    reps = spark.createDataFrame([r[:3] for r in rows], "id bigint, n bigint, keys array<bigint>")
    items = spark.createDataFrame([(r[0], r[3]) for r in rows], "id bigint, items array<bigint>")
    pairs = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    got = {r.node: r.component for r in near_dedup.linked_groups(reps, lambda ids: items, 80).collect()}
    place = {n: i for i, n in enumerate(order)}
    want = {}
    for n in range(100):
        a, b = place[n], place[1900 + n]
        want |= {a: min(a, b), b: min(a, b)}
    assert got == want
    assert sum(pairs) < 2 * len(rows)


@pytest.mark.parametrize("side", [False, True])
def test_joining_links_against_all_pairs(side):
    draw = random.Random(8)
    sets = []
    for _ in range(12):
        base = draw.sample(range(10**6), 60)
        sets += [np.array(sorted(set(base[draw.randrange(6) :]) | {draw.randrange(10**6) for _ in range(draw.randrange(5))})) for _ in range(5)]
    component = np.array([draw.choice([i, i - i % 5]) for i in range(60)])
    sides = np.array([draw.randrange(2) for _ in sets])
    links = near_dedup.joining_links(sets, component, sides if side else None, 80)

    def groups(pairs):
        parent = {c: c for c in component.tolist()}

        def root(c):
            while parent[c] != c:
                c = parent[c]
            return c

        for i, j in pairs:
            parent[root(component[i])] = root(component[j])
        return {frozenset(c for c in parent if root(c) == r) for r in map(root, parent)}

    def like(i, j):
        both = len(set(sets[i]) & set(sets[j]))
        return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    every = [(i, j) for i, j in itertools.combinations(range(60), 2) if like(i, j) and (not side or sides[i] != sides[j])]
    assert groups(links) == groups(every)
    assert len(links) < len(set(component.tolist()))
