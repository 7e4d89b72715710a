"""The trip queries: trips by month for a range of distances, speed by weekday for a range of fares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import seconds_between, weekday
from ..operators.aggregates import grouped
from ..operators.predicates import closed, greater, where
from . import adapt
from .adapt import sql


def by_month(spark: SparkSession, d: str, lo: int, hi: int) -> DataFrame:
    chosen = where(adapt.trips(spark, d), closed("distance", lo, hi)).withColumn("month", F.month("pickup").cast("bigint"))
    return grouped(chosen, ["month"], trips=F.count(F.lit(1)))


def by_weekday(spark: SparkSession, d: str, lo: int, hi: int) -> DataFrame:
    chosen = where(adapt.trips(spark, d), lambda: F.col("distance") > 0, closed("fare", lo, hi), greater("dropoff", "pickup"))
    speed = F.round(F.avg(F.col("distance") / seconds_between(F.col("pickup"), F.col("dropoff"))) * 3600, 4)
    return grouped(chosen.withColumn("weekday", weekday(F.col("pickup"))), ["weekday"], speed=speed)


QUERIES, ORACLE_SQL = {}, {}
for _k, (_lo, _hi) in {"1": (2, 5), "2": (5, 15), "3": (15, 5000)}.items():
    QUERIES[f"trips_q1_{_k}"] = lambda s, d, lo=_lo, hi=_hi: by_month(s, d, lo, hi)
    ORACLE_SQL[f"trips_q1_{_k}"] = sql(f"select cast(month(pickup) as bigint) as month, count(*) as trips from trips where distance >= {_lo} and distance <= {_hi} group by 1")
for _k, (_lo, _hi) in {"1": (0, 2), "2": (2, 10), "3": (10, 5000)}.items():
    QUERIES[f"trips_q2_{_k}"] = lambda s, d, lo=_lo, hi=_hi: by_weekday(s, d, lo, hi)
    ORACLE_SQL[f"trips_q2_{_k}"] = sql(f"select cast(dayofweek(pickup) as bigint) as weekday, round(avg(distance / (epoch(dropoff) - epoch(pickup))) * 3600, 4) as speed from trips where distance > 0 and fare between {_lo} and {_hi} and dropoff > pickup group by 1")
