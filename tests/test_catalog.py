"""Every catalogue query against its SQL, and what the plans look like."""

import re

import pytest
from compare import connect, mismatch, type_mismatch

import __spark_entry__ as contract
from mirepoix.operators import skew
from mirepoix.plans import catalog

SF = "/root/testdata/sf0.001"
# this catalogue; other folders test their own queries
QUERIES = {name: run for name, run in contract.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in catalog.QUERIES}
# components whose sign is free: `pca` checks what does not depend on it
NO_SQL = {"pca_components"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert mismatch(df, con, ORACLES[name]) is None
    assert not type_mismatch(df, con, ORACLES[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_models_beat_the_majority(spark):
    labels = {r.DIFFICULTY: r.n for r in QUERIES["label_index"](spark, SF).collect()}
    majority = max(labels.values()) / sum(labels.values())
    scores = {r.model: r.accuracy for r in QUERIES["difficulty_accuracy"](spark, SF).collect()}
    assert scores["tree"] > majority


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["USER_ID", "RECIPE_ID", "RATING", "predicted_rating", "propR"] and df.count() > 0


@pytest.mark.parametrize("name", ["dedupe_reviews", "precision_at_k", "topk_overlap"])
def test_ranking_limits_rows_before_the_shuffle(spark, name):
    plan = final_plan(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def test_scans_read_only_what_is_used(spark):
    plan = final_plan(QUERIES["graph_counts"](spark, SF))
    schemas = set(re.findall(r"ReadSchema: (struct<[^\n]*)", plan))
    assert schemas and all("l_extendedprice" not in s and "l_comment" not in s for s in schemas)
    assert "PushedFilters" in plan and "Not(EqualTo(l_suppkey,0))" in plan


def test_pairs_are_added_up_before_the_shuffle(spark):
    plan = final_plan(QUERIES["ingredient_graph_blocked"](spark, SF))
    assert plan.count("partial_count") >= 2


@pytest.mark.parametrize(
    "name",
    [
        "propagation_predict",
        "similarity_table",
        "ingredient_profile_rel",
        "author_activity",
        "quota_split",
        "exclusive_interactions",
        "rated_split",
        "reviews_with_recipe",
    ],
)
def test_results_hold_when_every_key_is_heavy(spark, con, monkeypatch, name):
    monkeypatch.setattr(skew, "SHARD_ROWS", 3)
    assert mismatch(QUERIES[name](spark, SF), con, ORACLES[name]) is None
