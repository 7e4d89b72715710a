"""Aggregation: scalar reductions, grouped sums, counts and averages, and rollups that queries use again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Predicate
from .predicates import where as filtered


def reduced(df: DataFrame, **aggs: Column) -> DataFrame:
    """One row."""
    return df.agg(*(c.alias(k) for k, c in aggs.items()))


def folded(df: DataFrame, column: str, start: Column, step, name: str = "value") -> DataFrame:
    """A reduction of one's own: one row, `start` folded with all values; of no values, `start`. `step` of two values must not depend on their order or grouping. Nulls are passed over. Rows are folded in groups, by a tree of four levels, so that no list holds more than a small share of the rows; `start` comes in once, at the end."""
    now = df.select(F.col(column).alias("v"), F.monotonically_increasing_id().alias("i")).where("v is not null")
    for bits in (24, 16, 8):
        several = now.groupBy(F.pmod(F.xxhash64("i"), F.lit(1 << bits)).alias("g")).agg(F.collect_list("v").alias("vs"))
        now = several.select(F.aggregate(F.slice("vs", 2, F.size("vs")), F.get("vs", F.lit(0)), step).alias("v"), F.col("g").alias("i"))
    return now.agg(F.collect_list("v").alias("vs")).select(F.aggregate("vs", start, step).alias(name))


def grouped(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Groups by one or more keys."""
    return df.groupBy(*keys).agg(*(c.alias(k) for k, c in aggs.items()))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """For each column its number of distinct values, in one row."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*(count(F.col(c)).alias(c) for c in df.columns))


def average(total: Column, n: Column) -> Column:
    """A mean from sums, at the end: null where there is no row."""
    return F.try_divide(total, n)


def rollup_weekly(fact: DataFrame, date: DataFrame) -> DataFrame:
    """The pre-aggregate: revenue for each year, week, month and supplier."""
    day = date.select("d_key", "d_year", "d_weeknuminyear", "d_monthnuminyear")
    return fact.join(day, fact["lo_orderdate"] == day["d_key"]).groupBy("d_year", "d_weeknuminyear", "d_monthnuminyear", "lo_suppkey").agg(F.sum("lo_revenue").alias("rev_per_week"))


def from_rollup(rollup: DataFrame, supplier: DataFrame, where: Predicate) -> DataFrame:
    """Revenue by year and month of some suppliers, from the pre-aggregate."""
    s = filtered(supplier, where).select("s_key")
    return rollup.join(s, rollup["lo_suppkey"] == s["s_key"]).groupBy("d_year", "d_monthnuminyear").agg(F.sum("rev_per_week").alias("revenue"))
