"""The order-table queries 1, 3 and 5, and the form of 5 whose region is a list of nation keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import cents, times_cents
from ..operators.aggregates import average, grouped
from ..operators.predicates import at_most, below, equals, half_open, one_of, where
from ..sources.tables import table


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def q1(spark: SparkSession, d: str) -> DataFrame:
    """Sums by flag and status, exact: cents, 1/10000 and 1/1000000 of the unit as whole numbers, divided once at the end."""
    return q1_of(table(spark, d, "lineitem"))


def q1_of(lines: DataFrame) -> DataFrame:
    """Query 1 over some lines."""
    line = where(lines, at_most("l_shipdate", _day("1998-12-01") - F.expr("interval 90 days")))
    price, off, tax, qty = cents(F.col("l_extendedprice")), cents(F.col("l_discount")), cents(F.col("l_tax")), F.col("l_quantity").cast("bigint")
    out = grouped(line, ["l_returnflag", "l_linestatus"], q=F.sum(qty), p=F.sum(price), dp=F.sum(price * (100 - off)), ch=F.sum(price * (100 - off) * (100 + tax)), di=F.sum(off), count_order=F.count(F.lit(1)))
    n = F.col("count_order")
    return out.select("l_returnflag", "l_linestatus", F.col("q").alias("sum_qty"), (F.col("p") / 100).alias("sum_base_price"), (F.col("dp") / 10000).alias("sum_disc_price"), (F.col("ch") / 1000000).alias("sum_charge"), average(F.col("q"), n).alias("avg_qty"), average(F.col("p") / 100, n).alias("avg_price"), average(F.col("di") / 100, n).alias("avg_disc"), "count_order")


def q1_cents(spark: SparkSession, d: str) -> DataFrame:
    """The same in scale-2 arithmetic, each product cut to cents."""
    line = where(table(spark, d, "lineitem"), at_most("l_shipdate", _day("1998-12-01") - F.expr("interval 90 days")))
    price, off, tax = cents(F.col("l_extendedprice")), cents(F.col("l_discount")), cents(F.col("l_tax"))
    net = times_cents(price, 100 - off)
    return grouped(line, ["l_returnflag", "l_linestatus"], disc_price_cents=F.sum(net), charge_cents=F.sum(times_cents(net, 100 + tax)))


def _revenue() -> Column:
    return F.sum(cents(F.col("l_extendedprice")) * (100 - cents(F.col("l_discount"))))


def q3(spark: SparkSession, d: str, day: str = "1995-03-15", lines: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Revenue of orders of one segment, ordered before a day and shipped after it. `lines` and `orders`: the rows to take instead of the whole tables'."""
    lines = table(spark, d, "lineitem") if lines is None else lines
    orders = table(spark, d, "orders") if orders is None else orders
    c = where(table(spark, d, "customer"), equals("c_mktsegment", "BUILDING")).select("c_custkey")
    o = where(orders, below("o_orderdate", _day(day))).select("o_orderkey", "o_custkey", "o_orderdate")
    line = lines.where(F.col("l_shipdate") > _day(day)).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").join(line, F.col("o_orderkey") == line["l_orderkey"])
    return grouped(joined, ["l_orderkey", "o_orderdate"], revenue_e4=_revenue()).select("l_orderkey", "o_orderdate", F.lit(0).alias("o_shippriority"), (F.col("revenue_e4") / 10000).alias("revenue"))


def _q5(spark: SparkSession, d: str, nations: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    orders = table(spark, d, "orders") if orders is None else orders
    c, o, s = table(spark, d, "customer"), where(orders, half_open("o_orderdate", _day("1996-01-01"), _day("1996-01-01") + F.expr("interval 1 year"))), table(spark, d, "supplier")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    # Suppliers and customers of the same nation: the second key of the supplier join.
    local = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    sold = line.join(local, line["l_orderkey"] == local["o_orderkey"]).join(s, (F.col("l_suppkey") == s["s_suppkey"]) & (F.col("c_nationkey") == s["s_nationkey"]))
    return grouped(sold.join(nations, F.col("s_nationkey") == nations["n_nationkey"]), ["n_name"], revenue_e4=_revenue()).select("n_name", (F.col("revenue_e4") / 10000).alias("revenue"))


def q5(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    n, r = table(spark, d, "nation"), where(table(spark, d, "region"), equals("r_name", "ASIA"))
    return _q5(spark, d, n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_semi").select("n_nationkey", "n_name"), orders)


def q5_opt(spark: SparkSession, d: str) -> DataFrame:
    return _q5(spark, d, where(table(spark, d, "nation"), one_of("n_nationkey", (2, 7, 12, 17, 22))).select("n_nationkey", "n_name"))


_C = "cast(round(l_extendedprice * 100) as bigint)"
_D, _T = "cast(round(l_discount * 100) as bigint)", "cast(round(l_tax * 100) as bigint)"
_Q1 = "from lineitem where l_shipdate <= timestamp '1998-12-01' - interval 90 day group by l_returnflag, l_linestatus"
_Q3 = "select l_orderkey, o_orderdate, 0 as o_shippriority, cast(sum({c} * (100 - {d})) as bigint) / 10000 as revenue from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '{day}' and l_shipdate > timestamp '{day}' group by l_orderkey, o_orderdate"
_Q5 = f"select n_name, cast(sum({_C} * (100 - {_D})) as bigint) / 10000 as revenue from customer, orders, lineitem, supplier, nation{{more}} where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and {{where}} and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-01-01' + interval 1 year group by n_name"

QUERIES = {"tpch_q1": q1, "tpch_q1_cents": q1_cents, "tpch_q3": q3, "tpch_q3_1998": lambda s, d: q3(s, d, "1998-03-15"), "tpch_q5": q5, "tpch_q5opt": q5_opt}
ORACLE_SQL = {
    "tpch_q1": f"select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty, cast(sum({_C}) as bigint) / 100 as sum_base_price, cast(sum({_C} * (100 - {_D})) as bigint) / 10000 as sum_disc_price, cast(sum({_C} * (100 - {_D}) * (100 + {_T})) as bigint) / 1000000 as sum_charge, cast(sum(l_quantity) as bigint) / count(*) as avg_qty, cast(sum({_C}) as bigint) / 100 / count(*) as avg_price, cast(sum({_D}) as bigint) / 100 / count(*) as avg_disc, count(*) as count_order {_Q1}",
    "tpch_q1_cents": f"select l_returnflag, l_linestatus, cast(sum({_C} * (100 - {_D}) // 100) as bigint) as disc_price_cents, cast(sum({_C} * (100 - {_D}) // 100 * (100 + {_T}) // 100) as bigint) as charge_cents {_Q1}",
    "tpch_q3": _Q3.format(c=_C, d=_D, day="1995-03-15"),
    "tpch_q3_1998": _Q3.format(c=_C, d=_D, day="1998-03-15"),
    "tpch_q5": _Q5.format(more=", region", where="n_regionkey = r_regionkey and r_name = 'ASIA'"),
    "tpch_q5opt": _Q5.format(more="", where="s_nationkey in (2, 7, 12, 17, 22)"),
}
