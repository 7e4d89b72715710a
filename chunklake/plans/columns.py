"""Queries of one column: select_*, filter_* (closed range), count_* and sum_*."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_dimension
from ..operators.predicates import closed, where
from ..sources.tables import table
from . import adapt
from .adapt import sql

#: For each table its columns, each with the ends of the range that filter_* takes. Dates are texts.
COLUMNS = {
    "lineorder": {
        "lo_key": (100, 900), "lo_linenumber": (2, 4), "lo_custkey": (10, 200), "lo_partkey": (10, 500), "lo_suppkey": (5, 40), "lo_orderdate": (19960101, 19961231), "lo_orderpriority": ("1-URGENT", "2-HIGH"),
        "lo_quantity": (10, 20), "lo_extendedprice": (1_000_000, 2_000_000), "lo_ordtotalprice": (10_000_000, 20_000_000), "lo_discount": (1, 3), "lo_revenue": (1_000_000, 1_500_000), "lo_supplycost": (60_000, 80_000), "lo_tax": (2, 4), "lo_commitdate": (19970101, 19970630),
    },
    "date": {"d_year": (1996, 1997), "d_yearmonthnum": (199601, 199612), "d_yearmonth": ("Dec1997", "Feb1999"), "d_weeknuminyear": (6, 8)},
    "part": {"p_mfgr": ("MFGR#1", "MFGR#2"), "p_category": ("MFGR#12", "MFGR#14"), "p_brand1": ("MFGR#2221", "MFGR#2228"), "p_size": (5, 10)},
    "supplier": {"s_city": ("NATION_61", "NATION_65"), "s_nation": ("NATION_6", "NATION_6"), "s_region": ("AMERICA", "ASIA")},
    "customer": {"c_city": ("NATION_61", "NATION_65"), "c_nation": ("NATION_6", "NATION_6"), "c_region": ("AMERICA", "ASIA")},
    "lineitem": {"l_orderkey": (100, 900), "l_partkey": (10, 500), "l_suppkey": (5, 40), "l_linenumber": (2, 4), "l_quantity": (10, 20), "l_extendedprice": (10_000, 20_000), "l_discount": (0.015, 0.035), "l_tax": (0.015, 0.035), "l_returnflag": ("A", "N"), "l_linestatus": ("F", "F"), "l_shipdate": ("1996-01-01", "1996-06-30")},
    "orders": {"o_orderkey": (100, 900), "o_custkey": (10, 200), "o_orderdate": ("1996-01-01", "1996-06-30"), "o_orderpriority": ("1-URGENT", "2-HIGH")},
    "trips": {"vendor_id": (5, 40), "pickup": ("1996-01-01", "1996-06-30"), "dropoff": ("1997-01-01", "1997-06-30"), "distance": (2, 5), "fare": (2, 10), "store_and_fwd_flag": ("F", "F"), "location_id": (10, 200)},
}
#: Columns that are sums of money or counts.
SUMS = ("lo_quantity", "lo_extendedprice", "lo_ordtotalprice", "lo_discount", "lo_revenue", "lo_supplycost", "lo_tax")
#: Names of derived tables in SQL that differ.
_SQL_NAME = {"date": "date_d", "part": "part_d", "supplier": "supplier_d", "customer": "customer_d"}
_DATES = ("l_shipdate", "o_orderdate", "pickup", "dropoff")


def source(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    if name == "lineorder":
        return adapt.lineorder(spark, d, with_cost=column == "lo_supplycost")
    if name == "date":
        return date_dimension(spark)
    return table(spark, d, name) if name in ("lineitem", "orders") else getattr(adapt, name)(spark, d)


def select(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)


def filtered(df: DataFrame, column: str, low, high) -> DataFrame:
    """The column's values in a closed range."""
    return where(df, closed(column, low, high)).select(column)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _literal(column: str, x) -> str:
    return f"timestamp '{x}'" if column in _DATES else repr(x)


for _t, _columns in COLUMNS.items():
    _of = _SQL_NAME.get(_t, _t)
    for _c, (_lo, _hi) in _columns.items():
        QUERIES[f"select_{_c}"] = lambda s, d, t=_t, c=_c: select(source(s, d, t, c), c)
        ORACLE_SQL[f"select_{_c}"] = sql(f"select {_c} from {_of}")
        QUERIES[f"filter_{_c}"] = lambda s, d, t=_t, c=_c, lo=_lo, hi=_hi: filtered(source(s, d, t, c), c, *((F.lit(x).cast("timestamp_ntz") if c in _DATES else x) for x in (lo, hi)))
        ORACLE_SQL[f"filter_{_c}"] = sql(f"select {_c} from {_of} where {_c} between {_literal(_c, _lo)} and {_literal(_c, _hi)}")
        if _t == "lineorder":
            QUERIES[f"count_{_c}"] = lambda s, d, t=_t, c=_c: source(s, d, t, c).agg(F.count(c).alias("n"))
            ORACLE_SQL[f"count_{_c}"] = sql(f"select count({_c}) as n from lineorder")
        if _c in SUMS:
            QUERIES[f"sum_{_c}"] = lambda s, d, t=_t, c=_c: source(s, d, t, c).agg(F.sum(c).alias("total"))
            ORACLE_SQL[f"sum_{_c}"] = sql(f"select cast(sum({_c}) as bigint) as total from lineorder")
