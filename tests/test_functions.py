import math

import pytest
from pyspark.sql import functions as F

from mirepoix.functions import column_min, cosine, hash_fraction, minmax_scale, rating_round


def values(df):
    return [r[0] for r in df.collect()]


def test_rating_round_upward(spark):
    cases = {
        0.0: 0, 0.3: 0, 0.49: 0, 0.5: 1, 0.51: 1, 1.0: 1, 1.2: 2, 2.49: 3, 3.9: 4, 5.0: 5, -0.3: -1, -1.0: -1, -1.5: -2,
    }
    df = spark.createDataFrame([(v, w) for v, w in cases.items()], "v double, want int").coalesce(1)
    assert df.filter(~rating_round(F.col("v")).eqNullSafe(F.col("want"))).count() == 0
    assert dict(df.select(rating_round(F.col("v")).alias("r"), "v").dtypes)["r"] == "int"


def test_rating_round_null_and_nearest(spark):
    df = spark.createDataFrame([(None,), (2.49,), (2.5,)], "v double").coalesce(1)
    assert values(df.select(rating_round(F.col("v")))) == [None, 3, 3]
    assert values(df.select(rating_round(F.col("v"), "nearest"))) == [None, 2, 3]
    with pytest.raises(ValueError):
        rating_round(F.col("v"), "sideways")


def test_minmax_scale(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "v double").coalesce(1)
    assert values(df.select(minmax_scale(F.col("v")))) == [0.0, 1.25, 5.0]
    assert values(df.select(minmax_scale(F.col("v"), 0, 2, 10, 20))) == [10.0, 11.25, 15.0]
    with pytest.raises(ValueError):
        minmax_scale(F.col("v"), 1, 1)


def test_column_min_returns_second_when_either_is_null(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 7), (7, None)], "a int, b int").coalesce(1)
    assert values(df.select(column_min(F.col("a"), F.col("b")))) == [1, 2, 7, None]


def test_cosine_nulls_and_zero_length(spark):
    df = spark.createDataFrame(
        [(3.0, 4.0, 3.0, 4.0), (1.0, 0.0, 0.0, 1.0), (1.0, None, 1.0, 5.0), (0.0, 0.0, 1.0, 1.0)],
        "a double, b double, c double, d double",
    ).coalesce(1)
    got = values(df.select(cosine([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])))
    assert got[0] == pytest.approx(1.0)
    assert got[1] == 0.0
    assert got[2] == pytest.approx(1 / math.sqrt(26))
    assert got[3] is None


@pytest.mark.parametrize("portable", [False, True])
def test_hash_fraction_is_uniform_and_repeatable(spark, portable):
    df = spark.range(20_000).withColumn("u", F.col("id") % 100)
    fraction = hash_fraction("id", "u", seed=3, portable=portable)
    low, high, mean = df.select(fraction.alias("f")).agg(F.min("f"), F.max("f"), F.avg("f")).head()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.01
    first = df.filter(fraction < 0.7)
    again = df.repartition(13, "u").filter(fraction < 0.7)
    assert first.exceptAll(again).count() == 0 and first.count() == again.count()
    assert abs(first.count() / 20_000 - 0.7) < 0.02
    other = df.filter(hash_fraction("id", "u", seed=4, portable=portable) < 0.7)
    assert first.exceptAll(other).count() > 0
