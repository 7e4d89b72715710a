"""Star-schema and trip tables, derived from the order tables; only columns that a query uses are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_dimension, date_key
from ..functions.fixed import cents, int_div
from ..sources.tables import table


def lineorder(spark: SparkSession, d: str, with_cost: bool = False, lines: str = "true", of_orders: str = "true") -> DataFrame:
    """The fact table, in cents and percents. `with_cost` adds lo_supplycost, which takes a join with the parts. `lines` and `of_orders`: what a query's filters imply for the stored columns, so that it reaches the scans."""
    line, orders = table(spark, d, "lineitem").where(lines), table(spark, d, "orders").where(of_orders)
    out = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("lo_key"),
        F.col("l_linenumber").cast("bigint").alias("lo_linenumber"),
        F.col("o_custkey").alias("lo_custkey"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        date_key(F.col("o_orderdate")).alias("lo_orderdate"),
        F.col("o_orderpriority").alias("lo_orderpriority"),
        F.col("l_quantity").cast("bigint").alias("lo_quantity"),
        cents(F.col("l_extendedprice")).alias("lo_extendedprice"),
        cents(F.col("o_totalprice")).alias("lo_ordtotalprice"),
        cents(F.col("l_discount")).alias("lo_discount"),
        cents(F.col("l_tax")).alias("lo_tax"),
        date_key(F.col("l_shipdate")).alias("lo_commitdate"),
        int_div(cents(F.col("l_extendedprice")) * (100 - cents(F.col("l_discount"))), 100).alias("lo_revenue"),
    )
    if with_cost:
        part = table(spark, d, "part").select(F.col("p_partkey").alias("lo_partkey"), int_div(6 * cents(F.col("p_retailprice")), 10).alias("lo_supplycost"))
        out = out.join(part, "lo_partkey")
    return out


def part(spark: SparkSession, d: str) -> DataFrame:
    b = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint") - 1
    mfgr = F.concat(F.lit("MFGR#"), (int_div(b, 5) + 1).cast("string"))
    category = F.concat(mfgr, (b % 5 + 1).cast("string"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("p_key"),
        "p_name",
        mfgr.alias("p_mfgr"),
        category.alias("p_category"),
        F.concat(category, F.lpad((F.col("p_partkey") % 40 + 1).cast("string"), 2, "0")).alias("p_brand1"),
        "p_type",
        F.col("p_size").cast("bigint").alias("p_size"),
    )


def _placed(spark: SparkSession, d: str, name: str, c: str, key: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    where = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias(f"{c}_nation"), F.col("r_name").alias(f"{c}_region"))
    own = table(spark, d, name)
    return own.join(where, own[f"{c}_nationkey"] == where["n_nationkey"]).select(
        F.col(key).alias(f"{c}_key"),
        f"{c}_name",
        F.concat(F.substring(f"{c}_nation", 1, 9), (F.col(key) % 10).cast("string")).alias(f"{c}_city"),
        f"{c}_nation",
        f"{c}_region",
        *(["c_mktsegment"] if c == "c" else []),
    )


def supplier(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "supplier", "s", "s_suppkey")


def customer(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "customer", "c", "c_custkey")


def trips(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_suppkey").alias("vendor_id"),
        F.col("o_orderdate").alias("pickup"),
        F.col("l_shipdate").alias("dropoff"),
        F.col("l_quantity").alias("distance"),
        (cents(F.col("l_extendedprice")) / 100000).alias("fare"),
        F.col("l_linestatus").alias("store_and_fwd_flag"),
        F.col("o_custkey").alias("location_id"),
    )


def star(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every table by name."""
    return {"lineorder": lineorder(spark, d, True), "date": date_dimension(spark), "part": part(spark, d), "supplier": supplier(spark, d), "customer": customer(spark, d), "trips": trips(spark, d)}


#: The same tables in SQL, to stand before a query.
SQL_TABLES = r"""
part_d as (
  select p_partkey as p_key, p_name, 'MFGR#' || (b // 5 + 1) as p_mfgr, 'MFGR#' || (b // 5 + 1) || (b % 5 + 1) as p_category,
         'MFGR#' || (b // 5 + 1) || (b % 5 + 1) || lpad(cast(p_partkey % 40 + 1 as varchar), 2, '0') as p_brand1, p_type, cast(p_size as bigint) as p_size
  from (select *, cast(regexp_extract(p_brand, '(\d+)$', 1) as bigint) - 1 as b from part)
), lineorder as (
  select l_orderkey as lo_key, cast(l_linenumber as bigint) as lo_linenumber, o_custkey as lo_custkey, l_partkey as lo_partkey, l_suppkey as lo_suppkey,
         cast(strftime(o_orderdate, '%Y%m%d') as bigint) as lo_orderdate, o_orderpriority as lo_orderpriority, cast(l_quantity as bigint) as lo_quantity,
         cast(round(l_extendedprice * 100) as bigint) as lo_extendedprice, cast(round(o_totalprice * 100) as bigint) as lo_ordtotalprice,
         cast(round(l_discount * 100) as bigint) as lo_discount, cast(round(l_tax * 100) as bigint) as lo_tax, cast(strftime(l_shipdate, '%Y%m%d') as bigint) as lo_commitdate,
         cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)) // 100 as lo_revenue,
         6 * cast(round(p_retailprice * 100) as bigint) // 10 as lo_supplycost
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
), date_d as (
  select cast(strftime(d, '%Y%m%d') as bigint) as d_key, cast(d as date) as d_date, strftime(d, '%A') as d_dayofweek, strftime(d, '%B') as d_month, cast(year(d) as bigint) as d_year,
         cast(year(d) * 100 + month(d) as bigint) as d_yearmonthnum, strftime(d, '%b%Y') as d_yearmonth, cast(dayofweek(d) + 1 as bigint) as d_daynuminweek,
         cast(day(d) as bigint) as d_daynuminmonth, cast(dayofyear(d) as bigint) as d_daynuminyear, cast(month(d) as bigint) as d_monthnuminyear,
         cast((dayofyear(d) - 1 + 7 - (dayofweek(d) + 6) % 7) // 7 + 1 as bigint) as d_weeknuminyear, dayofweek(d) = 0 as d_lastdayinweekfl, d = last_day(d) as d_lastdayinmonthfl
  from (select timestamp '1992-01-01' + to_days(cast(i as integer)) as d from range(3653) t(i))
), placed as (
  select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey
), supplier_d as (
  select s_suppkey as s_key, s_name, left(n_name, 9) || (s_suppkey % 10) as s_city, n_name as s_nation, r_name as s_region from supplier join placed on s_nationkey = n_nationkey
), customer_d as (
  select c_custkey as c_key, c_name, left(n_name, 9) || (c_custkey % 10) as c_city, n_name as c_nation, r_name as c_region, c_mktsegment from customer join placed on c_nationkey = n_nationkey
), trips as (
  select l_suppkey as vendor_id, o_orderdate as pickup, l_shipdate as dropoff, l_quantity as distance, cast(round(l_extendedprice * 100) as bigint) / 100000 as fare,
         l_linestatus as store_and_fwd_flag, o_custkey as location_id
  from lineitem join orders on l_orderkey = o_orderkey
)
"""


def sql(body: str) -> str:
    return f"with {SQL_TABLES.strip()}\n{body.strip()}"
