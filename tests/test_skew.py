import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirepoix.operators.skew import heavy_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them key 0 (exact copies among them), some null keys."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400)
    return spark.range(3000).select(key.alias("k"), (F.col("id") % 7).alias("v"))


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(
        spark.createDataFrame([(0, -1), (5, -5)], "k bigint, w bigint")
    )


def test_heavy_keys(skewed):
    sizes = Counter(r.k for r in skewed.collect())
    want = {(k, math.ceil(n / 100)) for k, n in sizes.items() if n > 100}
    assert want and {(r.k, r["__shards"]) for r in heavy_keys(skewed, ["k"], 100).collect()} == want
    assert heavy_keys(skewed, ["k"], 5000).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("spread", [None, ["v"]])
def test_salted_join_equals_plain_join(skewed, lookup, how, spread):
    want = Counter(map(tuple, skewed.join(lookup, "k", how).collect()))
    got = Counter(map(tuple, salted_join(skewed, lookup, ["k"], how, spread=spread, shard_rows=100).collect()))
    assert got == want


def test_fan_out_keeps_the_result(skewed, lookup):
    want = Counter(map(tuple, skewed.join(lookup, "k").collect()))
    assert Counter(map(tuple, salted_join(skewed, lookup, ["k"], shard_rows=100, fan_out=True).collect())) == want


def test_two_keys_with_heavy_from_one(spark, skewed):
    left = skewed.withColumn("j", F.col("v") % 3)
    right = left.select("k", "j").distinct().withColumn("w", F.lit(1))
    got = salted_join(left, right, ["k", "j"], spread=["v"], heavy=heavy_keys(skewed, ["k"], 100))
    assert got.count() == left.join(right, ["k", "j"]).count()


def test_copies_of_one_row_are_spread(spark):
    copies = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    joined = salted_join(copies, right, ["k"], shard_rows=500, fan_out=True)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "SPARK_PARTITION_ID" in plan.upper()
    assert joined.count() == 4000
    salts = salted_join(copies, right, ["k"], shard_rows=500)
    assert salts.filter("w = 'x'").count() == 4000


def test_unsupported_join_type(skewed, lookup):
    with pytest.raises(ValueError):
        salted_join(skewed, lookup, ["k"], "full")


def test_every_heavy_key_is_split(spark):
    """More keys than any fixed number, and one far above the others: no shard is left large."""
    many = spark.range(60_000).select((F.col("id") % 1500).alias("k"))
    big = spark.range(30_000).select(F.lit(7).cast("bigint").alias("k"))
    heavy = {r.k: r["__shards"] for r in heavy_keys(many.unionByName(big), ["k"], 10).collect()}
    assert len(heavy) == 1500
    assert heavy[7] == 3004 and all(n == 4 for k, n in heavy.items() if k != 7)
