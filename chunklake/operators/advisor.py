"""Which codec suits a column: a sample of its chunks, written and read with each, measured."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import CODECS


def files_bytes(spark, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def sample_codecs(df: DataFrame, columns: list[str], folder: str, codecs: tuple[str, ...] = ("uncompressed", "snappy", "lz4", "gdeflate", "zstd"), ratio: float = 0.1, seed: int = 1) -> DataFrame:
    """column, codec, bytes, write_ms, read_ms: each column's sampled rows as a file of its own."""
    spark, rows = df.sparkSession, []
    sample = df.sample(ratio, seed)
    for c in columns:
        for codec in codecs:
            path = f"{folder}/sample-{uuid.uuid4().hex}"
            t = time.perf_counter()
            sample.select(c).write.option("compression", CODECS.get(codec, codec)).parquet(path)
            wrote = time.perf_counter()
            spark.read.parquet(path).write.format("noop").mode("overwrite").save()
            read = time.perf_counter()
            rows.append((c, codec, files_bytes(spark, path), 1000 * (wrote - t), 1000 * (read - wrote)))
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.createDataFrame(rows, "column string, codec string, bytes bigint, write_ms double, read_ms double")


def advise(samples: DataFrame) -> DataFrame:
    """column, best_ratio (the smallest), best_bandwidth (the fastest read)."""
    return samples.groupBy("column").agg(F.min_by("codec", F.struct("bytes", "codec")).alias("best_ratio"), F.min_by("codec", F.struct("read_ms", "codec")).alias("best_bandwidth"))


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement; raises if there are fewer."""
    found = df.orderBy(F.rand(seed)).limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return found


def slices(total: int, parts: int) -> list[range]:
    """Contiguous slices of 0 .. total - 1; the first ones are one longer where it doesn't divide."""
    size, rest = divmod(total, parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < rest)
        out.append(range(at, at + n))
        at += n
    return out
