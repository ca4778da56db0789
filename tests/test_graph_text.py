import math
from collections import Counter
from itertools import combinations

import pytest

from mirepoix.operators import cooccurrence, text

BASKETS = {1: [1, 2, 3], 2: [2, 3], 3: [1, 3, 3], 4: [4], 5: [1, 2, 3, 4]}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([(r, i) for r, items in BASKETS.items() for i in items], "ID_RECIPE int, ID_INGREDIENT int")


def brute_force(baskets):
    return Counter(p for items in baskets.values() for p in combinations(sorted(set(items)), 2))


def test_counts_equal_brute_force(baskets):
    got = {(r.ORIGIN, r.DESTINATION): r.N_RECIPES for r in cooccurrence.cooccurrence_counts(baskets).collect()}
    assert got == brute_force(BASKETS)


@pytest.mark.parametrize("block_rows", [1, 2, 3, 50])
def test_blocks_give_the_same_counts(spark, block_rows):
    wide = {1: list(range(40)), 2: list(range(20, 25)), 3: [7]}
    df = spark.createDataFrame([(r, i) for r, items in wide.items() for i in items], "ID_RECIPE int, ID_INGREDIENT int")
    got = cooccurrence.cooccurrence_counts(df, block_rows=block_rows)
    assert {(r.ORIGIN, r.DESTINATION): r.N_RECIPES for r in got.collect()} == brute_force(wide)


def test_directed_edges_are_symmetric(baskets):
    both = {tuple(r) for r in cooccurrence.directed_edges(cooccurrence.cooccurrence_counts(baskets)).collect()}
    assert both == {(b, a, n) for a, b, n in both} and len(both) == 2 * len(brute_force(BASKETS))


def test_top_n_breaks_ties_by_id(baskets):
    # 3 occurs in four recipes, 1 and 2 in three each
    assert rows(cooccurrence.top_n_ingredients(baskets, 2)) == rows(
        baskets.filter("ID_INGREDIENT IN (1, 3)").distinct()
    )


def test_pmi_and_probability(baskets):
    n = len(BASKETS)
    single = Counter(i for items in BASKETS.values() for i in set(items))
    for r in cooccurrence.ingredient_pmi(baskets).collect():
        p = brute_force(BASKETS)[r.ORIGIN, r.DESTINATION] / n
        assert r["P(ORIGIN,DESTINATION)"] == pytest.approx(p) and 0 <= p <= 1
        assert r["1/P(ORIGIN,DESTINATION)"] == pytest.approx(1 / p)
        assert r.PMI == pytest.approx(math.log2(p / (single[r.ORIGIN] / n * single[r.DESTINATION] / n)))
    assert cooccurrence.ingredient_graph(baskets).count() == len(brute_force(BASKETS))


def test_main_words(spark):
    lines = {
        "2 cups all-purpose flour, sifted (100%)": ["all-purpose", "flour", "sifted"],
        "1/2 teaspoon of Salt!": ["Salt"],
        "Cups 12inch": ["Cups"],
        "crème fraîche; egg's": [],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.main_words(df.t)).collect()}
    assert got == lines


def test_tokens_and_lemmas(spark):
    df = spark.createDataFrame([(1, 7, "fresh tomatoes chopped")], "LINE_NO int, ID_INGREDIENT int, TEXT_VALUE string")
    tokens = text.ingredient_tokens(df)
    assert rows(tokens) == [(7, 1, 0, "fresh"), (7, 1, 1, "tomatoes"), (7, 1, 2, "chopped")]
    lemmas = spark.createDataFrame([("tomatoes", "tomato"), ("onions", "onion")], "word string, lemma string")
    assert rows(text.lemmatise(tokens, lemmas)) == [(7, 1, 0, "fresh"), (7, 1, 1, "tomato"), (7, 1, 2, "chopped")]


def names_by_hand(lines, max_lines=15):
    """The naming rule on one ingredient's lists of words."""
    lines = lines[:max_lines]
    first = lines[0]
    seen = Counter(w for line in lines for w in set(line))
    keep = {w for w, n in seen.items() if w in first or n >= len(lines) // 2}
    return " ".join(sorted(keep, key=lambda w: (first.index(w) if w in first else 0, w)))


def test_names(spark):
    words = {
        1: [["red", "onion"], ["onion", "sliced"], ["onion", "sliced", "thin"], ["sweet", "onion"]],
        2: [["flour"]],
        3: [["zebra", "apple"]] + [["apple", "green"]] * 8 + [["late"]] * 30,
        4: [[]] + [["egg"]] * 3,
    }
    data = [(i, n, " ".join(line)) for i, lines in words.items() for n, line in enumerate(lines)]
    df = spark.createDataFrame(data, "ID_INGREDIENT int, LINE_NO int, TEXT_VALUE string").repartition(5)
    got = {r.ID_INGREDIENT: r.NAME for r in text.ingredient_names(df, max_lines=15).collect()}
    assert got == {i: names_by_hand(lines) for i, lines in words.items()}
    # without a limit the later lines of ingredient 3 have a say
    got = {r.ID_INGREDIENT: r.NAME for r in text.ingredient_names(df).collect()}
    assert got == {i: names_by_hand(lines) for i, lines in words.items()} | {3: "late zebra apple"}
    assert got[1] == "red sliced onion" and got[4] == "egg"


def test_names_with_lemmas(spark):
    df = spark.createDataFrame(
        [(1, 0, "ripe tomatoes"), (1, 1, "tomato"), (1, 2, "tomatoes diced")],
        "ID_INGREDIENT int, LINE_NO int, TEXT_VALUE string",
    )
    lemmas = spark.createDataFrame([("tomatoes", "tomato")], "word string, lemma string")
    assert text.ingredient_names(df, lemmas).head().NAME == "diced ripe tomato"


def test_rows_and_pairs_are_dealt_by_their_number(spark):
    df = spark.createDataFrame([(r, i) for r in range(30) for i in range(10)], "ID_RECIPE int, ID_INGREDIENT int")
    rows_ = cooccurrence._distinct_rows(df, "ID_RECIPE", "ID_INGREDIENT", task_rows=20)
    assert rows_.rdd.getNumPartitions() == 15
    # 30 recipes with 45 pairs each
    pairs = cooccurrence._pairs_across_blocks(rows_, "ID_RECIPE", "ID_INGREDIENT", 1000, task_rows=50)
    assert pairs.rdd.getNumPartitions() == 27 and pairs.count() == 30 * 45
