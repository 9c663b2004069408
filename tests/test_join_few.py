import os

import pytest

from sparkgap import tables
from sparkgap.plans import boards

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_rows_are_not_broadcast_however_small_spark_takes_them_for(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(200)] + [(None, 200)], "key int, n int")
    few = spark.range(5).selectExpr("int(id) as k", "concat('v', id) as v")
    salted = tables.join_few(rows, few, {"key": "k"}, spread=["n"], most=4)
    assert "Broadcast" not in plan(salted)
    assert sorted(salted.collect(), key=lambda r: r.n) == sorted(tables.join_few(rows, few, {"key": "k"}).collect(), key=lambda r: r.n)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["assigned_pair_requirement", "hierarchy_summary", "zone_spacing", "assigned_hierarchy_summary", "assigned_zone_spacing", "pair_requirement"])
def test_requirements_of_many_assignments_broadcast_none(spark, monkeypatch, name):
    text = lambda df: sorted(map(str, df.collect()))
    expected = text(boards.QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    salted = boards.QUERIES[name](spark, FOLDER)
    steps = plan(salted).split("== Initial Plan ==")[0].splitlines()
    assert not [s for s in steps if "BroadcastHashJoin" in s and "__few_salt" in s] and text(salted) == expected
