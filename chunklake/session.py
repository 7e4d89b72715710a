"""The Spark session that tests, the bench and the command line tools share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session: UTC, adaptive execution, a partition per core. On a cluster, spark-submit's own settings hold."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chunklake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
