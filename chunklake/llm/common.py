"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collected(spark: SparkSession) -> None:
    """Lets files of shuffles go that nothing needs again: the driver's JVM has to see that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again: its lineage is cut, so a lost executor costs no recomputation of what lies before. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    # The shuffles behind it are not needed again; their files go when the driver's JVM sees that.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written(), dealt into files by a column: tables of as many buckets join on it without a shuffle. The session's catalogue has an entry for it until discard()."""
    spark = df.sparkSession
    called = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{called}"
    df.write.bucketBy(min(buckets, 100_000), key).option("compression", "zstd").option("path", path).saveAsTable(called, format="parquet")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    spark.sparkContext._jvm.System.gc()
    out = spark.table(called)
    out._written, out._called = path, called
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of written() or bucketed() that nothing reads any more."""
    spark = df.sparkSession
    if hasattr(df, "_called"):
        spark.sql(f"DROP TABLE IF EXISTS {df._called}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two hashes with different seeds. Null has a key of its own."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def same_key(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Whether rows of two tables agree in some columns; nulls agree with each other."""
    return reduce(and_, (a[n].eqNullSafe(b[n]) if n == "id" else a[n] == b[n] for n in names))


def positional(df: DataFrame, **more: Column) -> DataFrame:
    """`df` with its columns named c0, c1, .., and columns of the operator's own beside them: whatever the caller's are called, none clashes."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)), *(x.alias(k) for k, x in more.items()))


def restored(df: DataFrame, names: list[str], changed: dict[str, Column] | None = None, **more: Column) -> DataFrame:
    """The caller's columns of positional() under their own names, some of them replaced; then `more`."""
    changed = changed or {}
    return df.select(*(changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)), *(x.alias(k) for k, x in more.items()))


def lower_ascii(c):
    """A-Z in lower case; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
