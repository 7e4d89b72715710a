"""A generator of the star schema: the same columns and distributions at any scale, each row from its number alone, so that tasks need no order and no state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DAYS, FIRST_DAY, date_dimension, date_key

#: Five regions of five nations each. Fixed values.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECI", "5-LOW"]
MODES = ["REG AIR", "AIR", "RAIL", "TRUCK", "MAIL", "FOB", "SHIP"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]


def _below(n: int, *seed) -> Column:
    """A number from 0 to n - 1 that depends on `seed` alone."""
    return F.pmod(F.xxhash64(*(x if isinstance(x, Column) else F.lit(x) for x in seed)), F.lit(n))


def _pick(values: list[str], *seed) -> Column:
    return F.get(F.array(*map(F.lit, values)), _below(len(values), *seed).cast("int"))


def _place(c: str, nation: Column) -> list[Column]:
    region = F.get(F.array(*map(F.lit, REGIONS)), (nation % 5).cast("int"))
    name = F.concat(F.lit("NATION_"), nation.cast("string"))
    return [F.concat(F.substring(name, 1, 9), _below(10, F.col("id"), f"{c}city").cast("string")).alias(f"{c}_city"), name.alias(f"{c}_nation"), region.alias(f"{c}_region")]


def customers(sf: float, factor: float = 1) -> int:
    return max(1, int(30_000 * sf * factor))


def generate(spark: SparkSession, sf: float, customer_factor: float = 1) -> dict[str, DataFrame]:
    """lineorder, part, supplier, customer and date. Two thirds of the customer keys order (those not divisible by three); order keys are sparse; `customer_factor` scales the customers, to which orders are then spread."""
    n_orders, n_supp, n_cust = max(1, int(1_500_000 * sf)), max(1, int(2_000 * sf)), customers(sf, customer_factor)
    n_part = max(1, int(200_000 * (1 + math.floor(math.log2(sf))) if sf >= 1 else 200_000 * sf))
    i = F.col("id")
    supplier = spark.range(1, n_supp + 1).select(i.alias("s_key"), F.format_string("Supplier#%09d", i).alias("s_name"), *_place("s", _below(25, i, "snation")))
    customer = spark.range(1, n_cust + 1).select(i.alias("c_key"), F.format_string("Customer#%09d", i).alias("c_name"), *_place("c", _below(25, i, "cnation")), _pick(SEGMENTS, i, "segment").alias("c_mktsegment"))
    mfgr = _below(5, i, "mfgr") + 1
    category = F.concat(F.lit("MFGR#"), mfgr.cast("string"), (_below(5, i, "category") + 1).cast("string"))
    part = spark.range(1, n_part + 1).select(i.alias("p_key"), F.concat(F.lit("MFGR#"), mfgr.cast("string")).alias("p_mfgr"), category.alias("p_category"), F.concat(category, F.lpad((_below(40, i, "brand") + 1).cast("string"), 2, "0")).alias("p_brand1"), (_below(50, i, "size") + 1).alias("p_size"))
    orders = spark.range(n_orders).select(i, F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + _below(7, i, "lines"))).alias("line"))
    line = F.col("line")
    cust = 1 + _below(n_cust, i, "cust")
    # Every third customer never orders.
    cust = F.when((cust % 3 == 0) & (cust > 1), cust - 1).otherwise(cust)
    key = F.shiftleft(F.shiftright(i, 3), 5) + i.bitwiseAND(7) + 1
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), _below(min(DAYS, 7 * 365), i, "day").cast("int"))
    base = orders.select(
        key.alias("lo_key"), line.alias("lo_linenumber"), cust.alias("lo_custkey"), (1 + _below(n_part, i, line, "part")).alias("lo_partkey"), (1 + _below(n_supp, i, line, "supp")).alias("lo_suppkey"),
        date_key(day).alias("lo_orderdate"), _pick(PRIORITIES, i, "priority").alias("lo_orderpriority"), (1 + _below(50, i, line, "quantity")).alias("lo_quantity"), _below(11, i, line, "discount").alias("lo_discount"),
        _below(9, i, line, "tax").alias("lo_tax"), _pick(MODES, i, line, "mode").alias("lo_shipmode"),
    )
    unit = 90_000 + (F.call_function("div", F.col("lo_partkey"), F.lit(10).cast("bigint")) % 20_001) + 100 * (F.col("lo_partkey") % 1000)
    lineorder = base.withColumn("lo_extendedprice", unit * F.col("lo_quantity")).withColumn("lo_revenue", F.call_function("div", F.col("lo_extendedprice") * (100 - F.col("lo_discount")), F.lit(100).cast("bigint"))).withColumn("lo_supplycost", F.call_function("div", 6 * unit, F.lit(10).cast("bigint")))
    return {"lineorder": lineorder, "part": part, "supplier": supplier, "customer": customer, "date": date_dimension(spark)}
