"""Queries against their SQL on the smallest tables; the driver compares all of them."""

import pytest

from chunklake.plans import catalogue, ssb

CHOSEN = [
    "ssb_q1_1", "ssb_q1_2", "ssb_q1_3", "ssb_q2_1", "ssb_q3_1", "ssb_q3_4", "ssb_q3_5c", "ssb_q4_1", "ssb_q4_2", "ssb_q2_1_pre_aggr", "ssb_pre_aggr", "ssb_scan_only2",
    "tpch_q1", "tpch_q1_cents", "tpch_q3_1998", "tpch_q5", "tpch_q5opt", "trips_q1_1", "trips_q2_2", "select_lo_revenue", "filter_p_brand1", "filter_l_shipdate", "count_lo_tax", "sum_lo_supplycost",
    "prune_q1_1_combined", "prune_q1_2_bloom", "prune_q3_1_hist", "prune_q3_3_bloom", "prune_tpch_q1_hist", "prune_trips_q1_minmax", "join_prune_q1_1", "clustered_q1_1", "meta_minmax", "meta_hist", "prune_skipped",
    "join_count", "join_rows", "prejoin", "distinct_counts", "fold_max", "sort_permutation", "tpch_q3_top", "shuffle_rows", "date_dimension",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(same, name):
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_every_query_is_registered_once():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 200


@pytest.mark.parametrize("k", ["1", "2"])
def test_join_orders_agree(spark, sf, k):
    rows = [sorted(map(tuple, ssb.QUERIES[f"ssb_q2_{k}_{o}"](spark, sf).collect())) for o in ("psd", "spd", "sdp", "dps", "dsp")]
    assert all(r == rows[0] for r in rows)


def test_join_strategies_agree(spark, sf):
    rows = [sorted(map(tuple, ssb.QUERIES[f"ssb_q3_1{v}"](spark, sf).collect())) for v in ("", "a", "c", "d")]
    assert rows[0] and all(r == rows[0] for r in rows)


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
