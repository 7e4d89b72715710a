"""Dates as the star schema needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The date dimension's first day, and its number of days.
FIRST_DAY, DAYS = "1992-01-01", 3653


def date_key(d: Column) -> Column:
    """yyyymmdd as a number."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).cast("bigint")


def weekday(d: Column) -> Column:
    """0 (Sunday) to 6."""
    return (F.dayofweek(d) - 1).cast("bigint")


def week_in_year(d: Column) -> Column:
    """Weeks begin on Monday; the days before the year's first Monday are week 1 or belong to it, by day-of-year arithmetic (not ISO)."""
    return F.call_function("div", F.dayofyear(d) - 1 + 7 - (weekday(d) + 6) % 7, F.lit(7).cast("bigint")) + 1


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def date_dimension(spark: SparkSession, first: str = FIRST_DAY, days: int = DAYS) -> DataFrame:
    """A calendar of fixed size: one row a day."""
    d = F.date_add(F.lit(first).cast("date"), F.col("id").cast("int"))
    day = spark.range(days).select(d.alias("d_date"))
    d = F.col("d_date")
    return day.select(
        date_key(d).alias("d_key"),
        "d_date",
        F.date_format(d, "EEEE").alias("d_dayofweek"),
        F.date_format(d, "MMMM").alias("d_month"),
        F.year(d).cast("bigint").alias("d_year"),
        (F.year(d) * 100 + F.month(d)).cast("bigint").alias("d_yearmonthnum"),
        F.date_format(d, "MMMyyyy").alias("d_yearmonth"),
        (weekday(d) + 1).alias("d_daynuminweek"),
        F.day(d).cast("bigint").alias("d_daynuminmonth"),
        F.dayofyear(d).cast("bigint").alias("d_daynuminyear"),
        F.month(d).cast("bigint").alias("d_monthnuminyear"),
        week_in_year(d).alias("d_weeknuminyear"),
        (weekday(d) == 0).alias("d_lastdayinweekfl"),
        (d == F.last_day(d)).alias("d_lastdayinmonthfl"),
    )
