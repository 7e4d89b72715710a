"""Which chunks a predicate can't skip, by their metadata. Every check is sound: a chunk with a matching row is kept."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metadata import Bloom, bucket, numeric

MODES = ("none", "minmax", "hist", "bloom", "combined")


@dataclass(frozen=True)
class Range:
    """A column between two values, both included; equal ends make it a point. None: no end on that side."""

    column: str
    low: object
    high: object


@dataclass(frozen=True)
class Points:
    """A column that equals one of some values."""

    column: str
    values: tuple


def minmax_check(c: str, low, high) -> Column:
    # A chunk of nulls alone has neither, and no row that passes.
    above = F.lit(True) if high is None else F.col(f"{c}_min") <= F.lit(high)
    below = F.lit(True) if low is None else F.col(f"{c}_max") >= F.lit(low)
    return F.coalesce(F.col(f"{c}_min").isNotNull() & above & below, F.lit(False))


def hist_check(c: str, low, high, kind: T.DataType, buckets: int) -> Column:
    """Some bucket between those of the ends isn't empty. Without a histogram: the least and the greatest value decide."""
    mn, mx = numeric(F.col(f"{c}_min"), kind), numeric(F.col(f"{c}_max"), kind)
    if mn is None:
        return minmax_check(c, low, high)
    lo, hi = (end if x is None else F.least(F.greatest(numeric(F.lit(x).cast(kind), kind), mn), mx) for x, end in ((low, mn), (high, mx)))
    first, last = bucket(lo, mn, mx, buckets), bucket(hi, mn, mx, buckets)
    some = F.exists(F.slice(F.col(f"{c}_hist"), (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), lambda n: n > 0)
    return minmax_check(c, low, high) & F.coalesce(some, F.lit(False))


def bloom_check(c: str, values, kind: T.DataType, bloom: Bloom) -> Column:
    """Some value may be in the chunk."""

    def held(value) -> Column:
        bits = [F.coalesce(F.call_function("shiftright", F.try_element_at(f"{c}_bloom", F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")).bitwiseAND(1), F.lit(0)) == 1 for b in bloom.places(F.lit(value).cast(kind))]
        return reduce(and_, bits)

    return reduce(or_, map(held, values))


def check(predicate: Range | Points, mode: str, kind: T.DataType, buckets: int = 16, bloom: Bloom | None = None) -> Column:
    """Whether a chunk may hold a row that fits. A Bloom filter answers for points only, ranges of whole numbers up to 16 long included; it says nothing of others. Strings and such have no histogram."""
    c = predicate.column
    ranges = [(predicate.low, predicate.high)] if isinstance(predicate, Range) else [(v, v) for v in predicate.values]
    points = list(predicate.values) if isinstance(predicate, Points) else None
    closed = points is None and predicate.low is not None and predicate.high is not None
    if closed and predicate.low == predicate.high:
        points = [predicate.low]
    if closed and points is None and isinstance(kind, T.IntegralType) and predicate.high - predicate.low < 16:
        points = list(range(predicate.low, predicate.high + 1))
    found = []
    if mode in ("minmax", "combined"):
        found.append(reduce(or_, (minmax_check(c, *r) for r in ranges)))
    if mode in ("hist", "combined"):
        found.append(reduce(or_, (hist_check(c, *r, kind, buckets) for r in ranges)))
    if mode in ("bloom", "combined") and bloom and points:
        found.append(bloom_check(c, points, kind, bloom))
    return reduce(and_, found) if found else F.lit(True)


def surviving(meta: DataFrame, predicates: list[Range | Points], mode: str, kinds: dict[str, T.DataType], buckets: int = 16, bloom: Bloom | None = None) -> DataFrame:
    """The metadata rows of chunks that no predicate rules out. `kinds`: the columns' types in the data."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return meta.where(reduce(and_, (check(p, mode, kinds[p.column], buckets, bloom) for p in predicates))) if predicates else meta


def join_pruned(meta: DataFrame, column: str, keys: DataFrame, key: str, steps: int = 64) -> DataFrame:
    """The metadata rows of chunks in whose range some key of a filtered dimension falls. Keys and ranges meet in equal steps of the key range, so that neither side is compared with all of the other."""
    low, high = meta.agg(F.min(f"{column}_min"), F.max(f"{column}_max")).first()
    if low is None:
        return meta
    width = max(1, (high - low) // steps + 1)
    step = lambda c: F.call_function("div", c - F.lit(low), F.lit(width).cast("bigint"))
    at = keys.select(F.col(key).alias("_key")).where(F.col("_key").between(low, high)).distinct().withColumn("_step", step(F.col("_key")))
    spread = meta.select("chunk_id", f"{column}_min", f"{column}_max").withColumn("_step", F.explode(F.sequence(step(F.col(f"{column}_min")), step(F.col(f"{column}_max")))))
    met = spread.join(at, "_step").where(F.col("_key").between(F.col(f"{column}_min"), F.col(f"{column}_max"))).select("chunk_id").distinct()
    return meta.join(met, "chunk_id", "left_semi")


def pruned_scan(data: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of some chunks of a clustered table: its partitions are chunks, so that others aren't read (dynamic partition pruning)."""
    return data.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def listed_scan(data: DataFrame, chunks: DataFrame, most: int = 10_000) -> DataFrame:
    """The same, with the chunks' numbers as a partition filter that is known when the scan is planned; only if they are `most` or fewer, else as pruned_scan() does."""
    ids = [r[0] for r in chunks.select("chunk_id").limit(most + 1).collect()]
    return pruned_scan(data, chunks) if len(ids) > most else data.where(F.col("chunk_id").isin(ids))


def skipped(meta: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: chunks, pruned_chunks, rows, pruned_rows."""
    a = meta.agg(F.count(F.lit(1)).alias("chunks"), F.sum("rows").alias("rows"))
    b = kept.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r"))
    return a.join(b).select("chunks", (F.col("chunks") - F.col("k")).alias("pruned_chunks"), "rows", (F.col("rows") - F.col("r")).alias("pruned_rows"))
