"""Hard negatives against a ranking of all scores."""

import math
import random

import duckdb
import numpy as np
import pytest

from mirepoix.llm.hard_negatives import LEAST, MOST, Anchor, Shard, hard_negatives, search
from mirepoix.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows, every):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if c is not None and usable(v)]
    out = []
    for i, c, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == c][:5]:
            low = [x for x in scored if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(low, 1)]
    return sorted(out)


def table(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def made(seed, n, dim, labels, values):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.choice(values) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, 300, 3, 3, [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]),  # many ties
        made(2, 200, 8, 2, [x / 100 for x in range(-100, 100)]),
        made(3, 200, 4, 2, [-0.7, -0.3]),
        made(4, 120, 2, 1, [0.5, 1.0]),  # no other label
    ],
)
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5)
    assert table(hard_negatives(df, lambda i: i % 10 == 0)) == brute_force(rows, 10)


def test_waves_give_the_same_rows(spark):
    rows = made(5, 150, 5, 3, [x / 10 for x in range(-10, 10)])
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = hard_negatives(df, lambda i: i % 5 == 0, wave=7)
    rows = [(i, c, [float(np.float32(x)) for x in v]) for i, c, v in rows]
    assert table(got) == brute_force(rows, 5)


def test_edges(spark):
    """Nulls, non-finite components, other lengths, no components, zero vectors, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.5]), (3, 2, [1.0, None]), (4, None, [1.0, 0.5]), (5, 2, None),
        (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [1.0, 0.5, 0.5]), (9, 1, [1.0, 0.0]), (10, 1, [0.0, 0.0]),
        (11, 2, [0.0, 0.0]), (20, 3, []), (21, 3, []), (22, 4, []), (30, 5, [-1.0, -1.0]), (31, 5, [1.0, 1.0]), (32, 6, [0.0, 0.1]),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, label int, embedding array<double>, id string, `a.b` string")
    assert table(hard_negatives(df, lambda i: i % 10 == 0)) == brute_force(rows, 10)
    none = spark.createDataFrame([(None, 1, [1.0]), *[(i, c, v) for i, c, v in rows[:1]]], "vec_id bigint, label int, embedding array<double>")
    assert table(hard_negatives(none, lambda i: i % 10 == 0)) == []
    assert table(hard_negatives(df.limit(0), lambda i: i % 10 == 0)) == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.9])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = table(hard_negatives(df, lambda i: i == 0))
    assert got == [(0, 1, rank, 2, 65536, 58880) for rank in (1, 1, 2, 2)]


def test_search_stops_before_the_end():
    """Rows that stand out are found without scoring the others; equal scores at the threshold are all read."""
    draw = np.random.default_rng(1)
    x = draw.integers(-20, 20, (5000, 4))
    x[17] = x[4000] = 100
    shard = Shard(np.arange(5000), np.zeros(5000), x)
    anchor = Anchor(-1, 0, np.array([3, 2, 1, 1]), np.array([LEAST]), np.array([MOST]))
    scored = search(shard, anchor, np.ones(5000, bool), 2)
    assert anchor.ids.tolist() == [17, 4000] and scored < 300
    same = Shard(np.arange(5000)[::-1], np.zeros(5000), np.ones((5000, 4), np.int64))
    anchor = Anchor(-1, 0, np.array([3, 2, 1, 1]), np.array([LEAST]), np.array([MOST]))
    assert search(same, anchor, np.ones(5000, bool), 2) == 5000 and anchor.ids.tolist() == [0, 1]


def test_large_numbers_are_exact():
    x = np.array([[2**30, 1], [2**30, 2], [2**30, 0]])
    anchor = Anchor(-1, 0, np.array([2**30, 1]), np.array([LEAST]), np.array([MOST]))
    search(Shard(np.arange(3), np.zeros(3), x), anchor, np.ones(3, bool), 3)
    assert anchor.ids.tolist() == [1, 0, 2] and anchor.scores.tolist() == [2**60 + 2, 2**60 + 1, 2**60]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_threshold_negatives']})").fetchall())
    got = table(QUERIES["op12_threshold_negatives"](spark, SF))
    assert got == want and got
