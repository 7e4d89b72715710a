"""Text and Parquet files: single tables and whole directories of tables, conversions, and a first look."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codecs that Parquet files can be written with, by the kind of compression that is wanted.
CODECS = {"lz4": "lz4_raw", "snappy": "snappy", "cascaded": "zstd", "gdeflate": "gzip", "bitcomp": "snappy", "ans": "zstd", "zstd": "zstd", "uncompressed": "uncompressed"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True, start: int | None = None, end: int | None = None) -> DataFrame:
    """A text table of a given schema. A delimiter at the end of rows is allowed. `start` and `end`: rows from start (1 is the first) to end, not included; the order is that of the files, which one pass numbers."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    trailing = T.StructType([*schema.fields, T.StructField("_trailing", T.StringType())])
    rows = spark.read.schema(trailing).option("sep", sep).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    if start is None and end is None:
        return rows.drop("_trailing")
    # Numbers grow within a file and from file to file; ranks need the rows before each partition only.
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    sizes = sorted(numbered.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    shift = F.create_map(*(F.lit(x) for p in before.items() for x in p)) if before else F.create_map(F.lit(0), F.lit(0))
    row = F.element_at(shift, F.shiftright("_at", 33)) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    keep = (row >= (start or 1)) & (row < end if end else F.lit(True))
    return numbered.where(keep).drop("_at", "_trailing")


def write_csv(df: DataFrame, path: str, sep: str = ",", trailing: bool = False) -> None:
    """A text table with a header. `trailing` puts a delimiter at the end of each row, too."""
    df = df.withColumn("", F.lit(None).cast("string")) if trailing else df
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def read_tables(spark: SparkSession, path: str, names: list[str], schemas: dict[str, T.StructType | str] | None = None, sep: str = ",") -> dict[str, DataFrame]:
    """A directory of tables: <name>.csv if schemas are given, else <name>.parquet."""
    if schemas:
        return {n: read_csv(spark, f"{path}/{n}.csv", schemas[n], sep) for n in names}
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet", codec: str = "snappy", sep: str = ",") -> None:
    for name, df in tables.items():
        if kind == "csv":
            write_csv(df, f"{path}/{name}.csv", sep)
        else:
            df.write.mode("overwrite").option("compression", CODECS.get(codec, codec)).parquet(f"{path}/{name}.parquet")


def peek(df: DataFrame, n: int = 10) -> list:
    return df.take(n)


def main(args: list[str] | None = None) -> None:
    """Command line: csv2parquet, parquet2csv, peek, pre_aggr, sort."""
    p = argparse.ArgumentParser(description="Converts tables.")
    p.add_argument("op", choices=["csv2parquet", "parquet2csv", "peek", "pre_aggr", "sort"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--schema", help="column names and types, as in SQL")
    p.add_argument("--by", default="", help="sort: columns, with commas")
    p.add_argument("--sep", default=",")
    p.add_argument("--codec", default="snappy")
    a = p.parse_args(args)
    from ..session import session

    spark = session()
    if a.op == "csv2parquet":
        read_csv(spark, a.source, a.schema, a.sep).write.mode("overwrite").option("compression", CODECS.get(a.codec, a.codec)).parquet(a.target)
    elif a.op == "parquet2csv":
        write_csv(spark.read.parquet(a.source), a.target, a.sep)
    elif a.op == "sort":
        spark.read.parquet(a.source).orderBy(*a.by.split(",")).write.mode("overwrite").option("compression", CODECS.get(a.codec, a.codec)).parquet(a.target)
    elif a.op == "pre_aggr":
        from ..functions.dates import date_dimension
        from ..operators.aggregates import rollup_weekly
        from ..plans.adapt import lineorder

        rollup_weekly(lineorder(spark, a.source), date_dimension(spark)).write.mode("overwrite").parquet(a.target)
    else:
        for row in peek(spark.read.parquet(a.source)):
            print(row)


if __name__ == "__main__":
    main()
