"""The star-schema queries, with their variants: join orders, join strategies, cached inputs, rollups."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_dimension
from ..operators.aggregates import from_rollup, grouped, reduced, rollup_weekly
from ..operators.joins import Dimension, star_join
from ..operators.predicates import Predicate, at_least, below, closed, equals, every, one_of, optional, starts_with, where
from ..sources.tables import stored
from . import adapt
from .adapt import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _total(c: str = "lo_revenue") -> Column:
    return F.sum(c)


def q1(date_where: Predicate, fact_where: Predicate, price: bool = False, cached: bool = False, hint: str | None = None, lines: str = "true", days: str = "true") -> Query:
    """Revenue of discounts, filtered by date, discount and quantity. `lines` and `days`: what the filters imply for stored columns; a cached table goes without."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        fact = adapt.lineorder(spark, d) if cached else adapt.lineorder(spark, d, lines=lines, of_orders=days)
        fact = fact.cache() if cached else fact
        fact = where(fact, fact_where, optional(closed("lo_extendedprice", 3_990_000, 4_000_000), price))
        joined = star_join(fact, [Dimension(date_dimension(spark), "d_key", "lo_orderdate", where=date_where)], hint)
        return reduced(joined, revenue=F.sum(F.col("lo_extendedprice") * F.col("lo_discount")))

    return run


def q2(part_where: Predicate, supplier_where: Predicate, order: str = "psd", cached: bool = False, hint: str | None = None) -> Query:
    """Revenue by year and brand. `order`: the letters of part, supplier and date, as they are probed."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        dims = {
            "p": Dimension(adapt.part(spark, d), "p_key", "lo_partkey", ("p_brand1",), part_where),
            "s": Dimension(adapt.supplier(spark, d), "s_key", "lo_suppkey", (), supplier_where),
            "d": Dimension(date_dimension(spark), "d_key", "lo_orderdate", ("d_year",)),
        }
        fact = adapt.lineorder(spark, d)
        joined = star_join(fact.cache() if cached else fact, [dims[x] for x in order], hint)
        return grouped(joined, ["d_year", "p_brand1"], revenue=_total())

    return run


def q3(level: str, customer_where: Predicate, supplier_where: Predicate, date_where: Predicate, hint: str | None = None, cached: bool = False, days: str = "true") -> Query:
    """Revenue by customer's and supplier's nation or city, and year."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        dims = [
            Dimension(adapt.customer(spark, d), "c_key", "lo_custkey", (f"c_{level}",), customer_where),
            Dimension(adapt.supplier(spark, d), "s_key", "lo_suppkey", (f"s_{level}",), supplier_where),
            Dimension(date_dimension(spark), "d_key", "lo_orderdate", ("d_year",), date_where),
        ]
        fact = adapt.lineorder(spark, d, of_orders="true" if cached else days)
        return grouped(star_join(fact.cache() if cached else fact, dims, hint), [f"c_{level}", f"s_{level}", "d_year"], revenue=_total())

    return run


def q4(keys: list[str], customer_where: Predicate, supplier_where: Predicate, part_where: Predicate, date_where: Predicate | None = None, cached: bool = False, hint: str | None = None, days: str = "true") -> Query:
    """Profit by `keys`."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        keep = lambda c: tuple(k for k in keys if k.startswith(c))
        dims = [
            Dimension(adapt.supplier(spark, d), "s_key", "lo_suppkey", keep("s_"), supplier_where),
            Dimension(adapt.customer(spark, d), "c_key", "lo_custkey", keep("c_"), customer_where),
            Dimension(adapt.part(spark, d), "p_key", "lo_partkey", keep("p_"), part_where),
            Dimension(date_dimension(spark), "d_key", "lo_orderdate", keep("d_"), date_where),
        ]
        fact = adapt.lineorder(spark, d, with_cost=True, of_orders="true" if cached else days)
        return grouped(star_join(fact.cache() if cached else fact, dims, hint), keys, profit=F.sum(F.col("lo_revenue") - F.col("lo_supplycost")))

    return run


FROM = "from lineorder join date_d on lo_orderdate = d_key join part_d on lo_partkey = p_key join supplier_d on lo_suppkey = s_key join customer_d on lo_custkey = c_key"


def _sql(select: str, where: str, group: str = "") -> str:
    return sql(f"select {select} {FROM} where {where}" + (f" group by {group}" if group else ""))


def _add(name: str, query: Query, text: str) -> None:
    QUERIES[f"ssb_{name}"] = query
    ORACLE_SQL[f"ssb_{name}"] = text


REVENUE, PROFIT, GAIN = "cast(sum(lo_revenue) as bigint) as revenue", "cast(sum(lo_revenue - lo_supplycost) as bigint) as profit", "cast(sum(lo_extendedprice * lo_discount) as bigint) as revenue"
#: Of each first-flight query: filters on dates and facts, and the same as text.
FLIGHT1 = {
    "1": (equals("d_year", 1996), every(closed("lo_discount", 1, 3), below("lo_quantity", 25)), "d_year = 1996 and lo_discount between 1 and 3 and lo_quantity < 25"),
    "2": (equals("d_yearmonthnum", 199601), every(closed("lo_discount", 4, 6), closed("lo_quantity", 26, 35)), "d_yearmonthnum = 199601 and lo_discount between 4 and 6 and lo_quantity between 26 and 35"),
    "3": (every(equals("d_weeknuminyear", 6), equals("d_year", 1997)), every(closed("lo_discount", 5, 7), closed("lo_quantity", 26, 35)), "d_weeknuminyear = 6 and d_year = 1997 and lo_discount between 5 and 7 and lo_quantity between 26 and 35"),
}
FLIGHT2 = {
    "1": (equals("p_category", "MFGR#12"), equals("s_region", "AMERICA"), "p_category = 'MFGR#12' and s_region = 'AMERICA'"),
    "2": (closed("p_brand1", "MFGR#2221", "MFGR#2228"), equals("s_region", "ASIA"), "p_brand1 between 'MFGR#2221' and 'MFGR#2228' and s_region = 'ASIA'"),
    "3": (equals("p_brand1", "MFGR#2239"), equals("s_region", "EUROPE"), "p_brand1 = 'MFGR#2239' and s_region = 'EUROPE'"),
}
YEARS, CITIES = closed("d_year", 1996, 2000), ("NATION_61", "NATION_65")
FLIGHT3 = {
    "1": ("nation", equals("c_region", "ASIA"), equals("s_region", "ASIA"), YEARS, "c_region = 'ASIA' and s_region = 'ASIA' and d_year between 1996 and 2000"),
    "2": ("city", equals("c_nation", "NATION_6"), equals("s_nation", "NATION_6"), YEARS, "c_nation = 'NATION_6' and s_nation = 'NATION_6' and d_year between 1996 and 2000"),
    "3": ("city", one_of("c_city", CITIES), one_of("s_city", CITIES), YEARS, "c_city in ('NATION_61', 'NATION_65') and s_city in ('NATION_61', 'NATION_65') and d_year between 1996 and 2000"),
    "4": ("city", equals("c_region", "AMERICA"), equals("s_region", "AMERICA"), equals("d_yearmonth", "Dec1997"), "c_region = 'AMERICA' and s_region = 'AMERICA' and d_yearmonth = 'Dec1997'"),
    "4_two_cities": ("city", one_of("c_city", CITIES), one_of("s_city", CITIES), equals("d_yearmonth", "Dec1997"), "c_city in ('NATION_61', 'NATION_65') and s_city in ('NATION_61', 'NATION_65') and d_yearmonth = 'Dec1997'"),
    "5c": ("nation", starts_with("c_region", "A"), starts_with("s_region", "A"), YEARS, "c_region like 'A%' and s_region like 'A%' and d_year between 1996 and 2000"),
}
AMERICA = (equals("c_region", "AMERICA"), equals("s_region", "AMERICA"))
MAKERS = one_of("p_mfgr", ("MFGR#1", "MFGR#2"))
FLIGHT4 = {
    "1": (["d_year", "c_nation"], *AMERICA, MAKERS, None, "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('MFGR#1', 'MFGR#2')"),
    "2": (["d_year", "s_nation", "p_category"], *AMERICA, MAKERS, one_of("d_year", (1997, 1998)), "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('MFGR#1', 'MFGR#2') and d_year in (1997, 1998)"),
    "3": (["d_year", "s_city", "p_brand1"], equals("c_region", "AMERICA"), equals("s_nation", "NATION_6"), equals("p_category", "MFGR#14"), one_of("d_year", (1997, 1998)), "c_region = 'AMERICA' and s_nation = 'NATION_6' and p_category = 'MFGR#14' and d_year in (1997, 1998)"),
}
#: Join strategies of the hybrid variants, which differ in placement only.
HINTS = {"a": "broadcast", "c": "shuffle_hash", "d": "merge"}

def _days(first: str, last: str) -> str:
    """Order dates from one day to before another, as a filter of the stored column."""
    return f"o_orderdate >= timestamp_ntz'{first}' and o_orderdate < timestamp_ntz'{last}'"


#: What the filters of the first flight imply for stored lines (a rate is rounded to percents, hence the margin) and orders; of the others for orders. The filters themselves still decide.
SOURCE1 = {
    "1": ("l_discount >= 0.0049 and l_discount < 0.0351 and l_quantity < 25", _days("1996-01-01", "1997-01-01")),
    "2": ("l_discount >= 0.0349 and l_discount < 0.0651 and l_quantity >= 26 and l_quantity < 36", _days("1996-01-01", "1996-02-01")),
    "3": ("l_discount >= 0.0449 and l_discount < 0.0751 and l_quantity >= 26 and l_quantity < 36", _days("1997-01-01", "1998-01-01")),
}
DAYS3 = {k: _days("1997-12-01", "1998-01-01") if k.startswith("4") else _days("1996-01-01", "2001-01-01") for k in FLIGHT3}
DAYS4 = {"1": "true", "2": _days("1997-01-01", "1999-01-01"), "3": _days("1997-01-01", "1999-01-01")}

for k, (dw, fw, text) in FLIGHT1.items():
    _add(f"q1_{k}", q1(dw, fw, lines=SOURCE1[k][0], days=SOURCE1[k][1]), _sql(GAIN, text))
    _add(f"q1_{k}_inmem", q1(dw, fw, cached=True), _sql(GAIN, text))
_add("q1_1_price", q1(*FLIGHT1["1"][:2], price=True), _sql(GAIN, FLIGHT1["1"][2] + " and lo_extendedprice between 3990000 and 4000000"))
for k, (pw, sw, text) in FLIGHT2.items():
    _add(f"q2_{k}", q2(pw, sw), _sql(f"d_year, p_brand1, {REVENUE}", text, "d_year, p_brand1"))
    _add(f"q2_{k}_inmem", q2(pw, sw, cached=True), _sql(f"d_year, p_brand1, {REVENUE}", text, "d_year, p_brand1"))
    for order in ("psd", "spd", "sdp", "dps", "dsp"):
        _add(f"q2_{k}_{order}", q2(pw, sw, order), _sql(f"d_year, p_brand1, {REVENUE}", text, "d_year, p_brand1"))
for k, (level, cw, sw, dw, text) in FLIGHT3.items():
    keys = f"c_{level}, s_{level}, d_year"
    _add(f"q3_{k}", q3(level, cw, sw, dw, days=DAYS3[k]), _sql(f"{keys}, {REVENUE}", text, keys))
for k, (v, hint) in product("1234", HINTS.items()):
    level, cw, sw, dw, text = FLIGHT3[k]
    _add(f"q3_{k}{v}", q3(level, cw, sw, dw, hint, days=DAYS3[k]), _sql(f"c_{level}, s_{level}, d_year, {REVENUE}", text, f"c_{level}, s_{level}, d_year"))
for k in "1234":
    level, cw, sw, dw, text = FLIGHT3[k]
    _add(f"q3_{k}_inmem", q3(level, cw, sw, dw, cached=True), _sql(f"c_{level}, s_{level}, d_year, {REVENUE}", text, f"c_{level}, s_{level}, d_year"))
for k, (keys, cw, sw, pw, dw, text) in FLIGHT4.items():
    _add(f"q4_{k}", q4(keys, cw, sw, pw, dw, days=DAYS4[k]), _sql(f"{', '.join(keys)}, {PROFIT}", text, ", ".join(keys)))
    _add(f"q4_{k}_inmem", q4(keys, cw, sw, pw, dw, cached=True), _sql(f"{', '.join(keys)}, {PROFIT}", text, ", ".join(keys)))


def _pre_aggregated(chosen: Predicate) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rollup = stored(spark, "rollup", d, lambda path: rollup_weekly(adapt.lineorder(spark, d), date_dimension(spark)).write.parquet(path))
        return from_rollup(rollup, adapt.supplier(spark, d), chosen)

    return run


for k, chosen, text in (("1", equals("s_region", "AMERICA"), "s_region = 'AMERICA'"), ("2", equals("s_nation", "NATION_6"), "s_nation = 'NATION_6'")):
    _add(f"q2_{k}_pre_aggr", _pre_aggregated(chosen), _sql(f"d_year, d_monthnuminyear, {REVENUE}", text, "d_year, d_monthnuminyear"))
_add(
    "pre_aggr",
    lambda spark, d: rollup_weekly(adapt.lineorder(spark, d), date_dimension(spark)),
    _sql("d_year, d_weeknuminyear, d_monthnuminyear, lo_suppkey, cast(sum(lo_revenue) as bigint) as rev_per_week", "true", "all"),
)
_add("scan_only", lambda s, d: reduced(where(adapt.lineorder(s, d), below("lo_orderdate", 20000101)), n=F.count(F.lit(1))), sql("select count(*) as n from lineorder where lo_orderdate < 20000101"))
_add("scan_only2", lambda s, d: reduced(where(adapt.lineorder(s, d), below("lo_orderdate", 20000101), at_least("lo_custkey", 750)), n=F.count(F.lit(1))), sql("select count(*) as n from lineorder where lo_orderdate < 20000101 and lo_custkey >= 750"))
