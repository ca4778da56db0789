"""Benchmark items in documents against a plain edit-distance search."""

import random

from mirepoix.llm.decontaminate import ERROR_RATE, masks, myers, normalised, with_leaks


def least_distance(item, text):
    """Smallest edit distance of ``item`` to any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def edited(text, n, draw):
    text = list(text)
    for _ in range(n):
        i = draw.randrange(len(text))
        text[i] = draw.choice(["", draw.choice("abcxyz"), text[i] + draw.choice("abcxyz")])
    return "".join(text)


def test_equals_brute_force(spark, documents):
    draw = random.Random(8)
    items = [(i, "".join(draw.choice("abcd efgh") for _ in range(draw.choice([12, 40, 70])))) for i in range(8)]
    rows = []
    for n in range(60):
        noise = lambda: "".join(draw.choice("abcd efgh") for _ in range(draw.randrange(60)))
        middle = edited(draw.choice(items)[1], draw.choice([0, 1, 3, 6, 12]), draw)
        rows.append((n, noise() + middle.upper().replace(" ", "\n ") + noise()))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(*rows)
    got = {r.doc_id: {x.item_id: x.distance for x in r.leaks} for r in with_leaks(docs, benchmark).collect()}
    several = {r.doc_id: {x.item_id: x.distance for x in r.leaks} for r in with_leaks(docs, benchmark, pass_chars=100).collect()}
    assert got.keys() == several.keys() == {n for n, _ in rows}
    for n, text in rows:
        want = set()
        for i, item in items:
            item = normalised(item)
            if least_distance(item, normalised(text)) <= int(len(item) * ERROR_RATE):
                want.add(i)
        assert got[n].keys() == several[n].keys() == want, n


def test_bit_parallel_distance():
    draw = random.Random(2)
    for _ in range(200):
        item = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 90)))
        text = edited(item, draw.randrange(9), draw) + "".join(draw.choice("abc") for _ in range(draw.randrange(9)))
        want = least_distance(item, text)
        for budget in (want, want + 2):
            hit = myers(masks(item), len(item), text, budget)
            assert hit is not None and hit[0] == want
        if want:
            assert myers(masks(item), len(item), text, want - 1) is None


def test_edges(spark, documents):
    """Nulls, blanks and repeated rows; all columns of the documents stay."""
    benchmark = spark.createDataFrame([(1, "a planted question of the test"), (2, None), (3, ""), (4, "  "), (1, "a planted question of the test")], "item_id bigint, text string")
    docs = documents((1, None), (2, ""), (3, "x " * 100_000 + "A planted\nquestion of the test"), (4, "clean"), (4, "clean"))
    found = with_leaks(docs, benchmark)
    assert found.columns == [*docs.columns, "leaks"]
    got = sorted((r.doc_id, tuple(x.item_id for x in r.leaks)) for r in found.collect())
    assert got == [(1, ()), (2, ()), (3, (1,)), (4, ()), (4, ())]
    assert with_leaks(docs, benchmark.filter("item_id > 9")).filter("size(leaks) > 0").count() == 0
    assert with_leaks(docs.filter("doc_id > 9"), benchmark).count() == 0


def test_clashing_names_and_passes(spark):
    docs = spark.createDataFrame([(1, "the test item number one", "a", "b", "c")], "doc_id int, text string, __look string, leaks string, `x.y` string")
    items = spark.createDataFrame([(i, f"the test item number {w}") for i, w in enumerate(["one", "two", "six"])], "item_id int, text string")
    got = with_leaks(docs, items, error_rate=0.01, pass_chars=30)
    assert got.columns == ["doc_id", "text", "__look", "x.y", "leaks"]
    assert [leak.item_id for leak in got.head().leaks] == [0]
