"""What is known of each chunk of a table: rows, least and greatest value, an equi-width histogram, a Bloom filter.

All are rows of one small table keyed by the chunk's number; they are made by grouped aggregation, so that any number of
chunks is handled alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bloom:
    """A filter of `size` bytes for a false-positive rate of `p` at its design load."""

    p: float = 0.01
    size: int = 1024

    @property
    def bits(self) -> int:
        return 8 * self.size

    @property
    def load(self) -> int:
        """Values for which the rate holds."""
        return max(1, math.ceil(self.bits * math.log(0.5 ** math.log(2)) / math.log(self.p)))

    @property
    def hashes(self) -> int:
        return max(1, math.ceil(math.log(2) * self.bits / self.load))

    def places(self, value: Column) -> list[Column]:
        """The bits of a value."""
        return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]


def numeric(c: Column, kind: T.DataType) -> Column | None:
    """A value as a whole number that keeps its order, for histograms: whole numbers as they are, days, microseconds; floating-point values in steps of 1/1000. Other types (strings) have none."""
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, T.DecimalType):
        return F.floor(c * 10**kind.scale).cast("bigint")
    if isinstance(kind, T.FractionalType):
        return F.floor(c * 1000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return None


def bucket(v: Column, low: Column, high: Column, buckets: int) -> Column:
    """Equal widths over [low, high]; a chunk of one value has it in bucket 0. Decimal arithmetic, since spans times buckets may pass 64 bits."""
    wide = F.call_function("div", (v - low).cast("decimal(25,0)") * F.lit(buckets), F.greatest(high - low, F.lit(1)).cast("decimal(25,0)"))
    return F.least(F.lit(buckets - 1).cast("bigint"), wide.cast("bigint"))


def min_max(df: DataFrame, columns: list[str], chunk: str = "chunk_id") -> DataFrame:
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("rows"), *(x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))))


def histogram(df: DataFrame, column: str, buckets: int, chunk: str = "chunk_id") -> DataFrame:
    """chunk, bucket, n: one row for each bucket that isn't empty. Nulls are in none."""
    v = numeric(F.col(column), df.schema[column].dataType)
    if v is None:
        raise TypeError(f"{column} has no histogram: its type has no distances")
    values = df.where(F.col(column).isNotNull()).select(chunk, v.alias("v"))
    ends = values.groupBy(chunk).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return values.join(ends, chunk).groupBy(chunk, bucket(F.col("v"), F.col("low"), F.col("high"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bloom_words(df: DataFrame, column: str, bloom: Bloom, chunk: str = "chunk_id") -> DataFrame:
    """chunk, word, bits: the words of 64 bits that aren't zero."""
    value = F.explode(F.array(*bloom.places(F.col(column)))).alias("bit")
    word = F.shiftright("bit", 6).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))
    return df.where(F.col(column).isNotNull()).select(chunk, value).groupBy(chunk, word.alias("word")).agg(F.bit_or(one).alias("bits"))


def chunk_metadata(df: DataFrame, columns: list[str], buckets: int = 16, bloom: Bloom | None = None, chunk: str = "chunk_id", histograms: list[str] | None = None) -> DataFrame:
    """One row a chunk: chunk, rows, <c>_min and <c>_max; <c>_hist (an array of counts) for columns with distances; <c>_bloom (a map from word to bits) if `bloom` is given."""
    out = min_max(df, columns, chunk)
    for c in columns:
        if numeric(F.col(c), df.schema[c].dataType) is not None and (histograms is None or c in histograms):
            full = histogram(df, c, buckets, chunk).groupBy(chunk).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
            counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("bigint")), F.lit(0)))
            out = out.join(full.select(chunk, counts.alias(f"{c}_hist")), chunk, "left")
        if bloom:
            words = bloom_words(df, c, bloom, chunk).groupBy(chunk).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(f"{c}_bloom"))
            out = out.join(words, chunk, "left")
    return out
