"""The N best of every group on small rows: nulls, ties, repeats, empty tables, one hot group, any N."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm import topn


@pytest.mark.parametrize("subgroups", [None, 1, 7])
def test_top_n(spark, subgroups):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), n, rng.choice([None, 1, 2, 2]), rng.choice(["x", "é", "Z", None])) for n in range(200)]
    df = spark.createDataFrame(rows * 3, "g string, i bigint, s bigint, name string").withColumns({"rank": F.lit("clash"), "subgroup": F.lit("clash")})
    got = {}
    for x in topn.top_n(df, F.col("g"), F.col("i"), [(F.col("s"), True), (F.col("name"), False)], 3, subgroups).collect():
        got.setdefault(x["group_key"], {})[x["rank"]] = x["item_id"]
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[3] is None, (r[3] or "").encode(), r[1]))
        assert got[g] == {k + 1: r[1] for k, r in enumerate(own[:3])}


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, i bigint")
    assert topn.top_n(df, F.col("g"), F.col("i"), [(F.col("i"), True)], 3).count() == 0
    some = spark.createDataFrame([(None, None), (None, None), ("a", None)], "g string, i bigint")
    assert sorted(map(tuple, topn.top_n(some, F.col("g"), F.col("i"), [(F.col("i"), True)], 3).collect()), key=str) == [("a", None, 1), (None, None, 1)]
    assert topn.top_n(some, F.col("g"), F.col("i"), [], 0).count() == 0


@pytest.mark.parametrize("n", [3, 1000, 2000])
def test_both_stages_are_in_the_plan_for_any_n(spark, n):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"))
    plan = topn.top_n(df, F.col("g"), F.col("id"), [(F.col("id"), True)], n)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x and "row_number" in x]
    assert len(windows) == 2
    assert sum("subgroup" in x for x in windows) == 1
    assert sum("hashpartitioning(group_key" in x and "subgroup" in x for x in plan.splitlines()) == 1


def test_many_best_of_a_hot_group(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    got = topn.top_n(df, F.col("g"), F.col("id"), [(-F.col("id"), True)], 2000).filter("group_key = 'hot'")
    assert sorted(x["item_id"] for x in got.collect()) == [k for k in range(3001) if k % 3][:2000]
