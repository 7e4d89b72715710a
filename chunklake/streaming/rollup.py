"""An extra: the weekly rollup kept up as chunk files arrive. Each micro-batch is rolled up alone and its partial sums are appended; readers sum them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import date_dimension
from ..operators.aggregates import rollup_weekly


def maintain(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """`chunks`: a stream with the fact table's columns. A batch that runs again replaces its own partial sums, so that each row counts once."""

    def put(batch: DataFrame, number: int) -> None:
        rollup_weekly(batch, date_dimension(batch.sparkSession)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(partial: DataFrame) -> DataFrame:
    return partial.groupBy("d_year", "d_weeknuminyear", "d_monthnuminyear", "lo_suppkey").agg(F.sum("rev_per_week").alias("rev_per_week"))
