"""Schemas of the fixed tables; unsigned numbers take the next larger signed type."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "lineorder": "lo_key bigint, lo_linenumber bigint, lo_custkey bigint, lo_partkey bigint, lo_suppkey bigint, lo_orderdate bigint, lo_orderpriority string, lo_shippriority string, lo_quantity bigint, lo_extendedprice bigint, lo_ordtotalprice bigint, lo_discount bigint, lo_revenue bigint, lo_supplycost bigint, lo_tax bigint, lo_commitdate bigint, lo_shipmode string",
    "part": "p_key bigint, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size bigint, p_container string",
    "supplier": "s_key bigint, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "customer": "c_key bigint, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "trips": "vendor_id bigint, pickup timestamp_ntz, dropoff timestamp_ntz, passenger_count bigint, distance double, rate_code bigint, store_and_fwd_flag string, pu_location bigint, do_location bigint, payment_type bigint, fare double, extra double, mta_tax double, tip double, tolls double, improvement_surcharge double, total double, congestion_surcharge double, airport_fee int",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])
