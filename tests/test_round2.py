"""Filters that reach the scans, stored tables, reductions with a start, sized broadcasts, and pruned order-table queries."""

import pytest
from chunklake.operators import aggregates, joins
from chunklake.plans import catalogue, chunks
from pyspark.sql import functions as F

CHOSEN = ["fold_sum_from", "fold_empty", "prune_tpch_q3_minmax", "prune_tpch_q5_hist", "prune_trips_q1_3_minmax", "prune_q1_3_combined", "ssb_q2_2_pre_aggr", "ssb_q3_4a", "ssb_q4_3"]


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(same, name):
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_filters_reach_the_scans(spark, sf):
    plan = catalogue.QUERIES["ssb_q1_1"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_discount,0.0049)" in plan and "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan


def test_pruned_queries_scan_the_stored_table_once(spark, sf):
    chunks.stored_fact(spark, sf)
    plan = catalogue.QUERIES["prune_q1_1_combined"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [" in plan and "chunk_id" in plan


@pytest.mark.parametrize("values, total", [([1, 2, 3], 16), ([], 10), ([None, 5], 15), ([None], 10)])
def test_folds_begin_with_the_start_once(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert aggregates.folded(df, "v", F.lit(10).cast("bigint"), lambda a, b: a + b).collect() == [(total,)]


def test_large_sides_are_not_broadcast(spark):
    assert joins.sized_hint(spark.range(10), "broadcast") == "broadcast"
    assert joins.sized_hint(spark.range(1 << 30), "broadcast") == "shuffle_hash"
    assert joins.sized_hint(spark.range(1 << 30), "merge") == "merge"
