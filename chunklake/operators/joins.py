"""Joins: lookups of dimension rows by key, star pipelines in a given order, semi joins, counts and prejoins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import Predicate
from .predicates import where as filtered


@dataclass
class Dimension:
    """One probe of a star pipeline. `where` filters its rows before they are built; `keep` names the columns that go on."""

    rows: DataFrame
    key: str
    fact_key: str
    keep: tuple[str, ...] = ()
    where: Predicate | None = None

    def built(self) -> DataFrame:
        rows = self.rows if self.where is None else filtered(self.rows, self.where)
        return rows.select(self.key, *self.keep)


#: Bytes of the tables that a side is made of, by Spark's estimate, up to which a broadcast that is asked for is made. A dimension's joins are N:1, so they don't multiply its rows.
MAX_BROADCAST = 64 << 20


def sized_hint(side: DataFrame, hint: str) -> str:
    """`hint`, but for a broadcast of a side that may be too large: that is hashed where it is shuffled to."""
    if hint != "broadcast":
        return hint
    leaves = side._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return hint if total <= MAX_BROADCAST else "shuffle_hash"


def star_join(fact: DataFrame, order: list[Dimension], hint: str | None = None) -> DataFrame:
    """Probes the dimensions one after the other. Sides are broadcast by Spark where their size allows it; `hint` (broadcast, shuffle_hash, merge) asks for another strategy, with the same result; a broadcast only up to MAX_BROADCAST."""
    for dim in order:
        side = dim.built()
        side = side.hint(sized_hint(side, hint)) if hint else side
        fact = fact.join(side, fact[dim.fact_key] == side[dim.key]).drop(side[dim.key])
    return fact


def lookup(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None, how: str = "inner") -> DataFrame:
    """N:1: each probe row meets one build row at most; rows of `build` that share a key count once."""
    build_key = build_key or key
    return probe.join(build.dropDuplicates([build_key]).withColumnRenamed(build_key, key), key, how)


def join_count(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """How many probe rows find a match: hits."""
    return probe.join(build.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("hits"))


def matching(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """Probe rows with a match, as they are."""
    return probe.join(build.select(key), key, "left_semi")


def build_keys(dim: Dimension) -> DataFrame:
    """The distinct keys of a filtered dimension: what join pruning tests."""
    return dim.built().select(dim.key).distinct()


def prejoin(fact: DataFrame, dims: list[Dimension]) -> DataFrame:
    """Fact rows with dimension attributes. Every fact row must find its dimension row; one that doesn't raises when it is computed."""
    for dim in dims:
        side = dim.built().dropDuplicates([dim.key])
        found = fact.join(side, fact[dim.fact_key] == side[dim.key], "left")
        checked = F.when(side[dim.key].isNotNull(), F.col(dim.fact_key)).otherwise(F.raise_error(F.concat(F.lit(f"no row of {dim.key} for "), F.col(dim.fact_key).cast("string"))).cast(fact.schema[dim.fact_key].dataType))
        fact = found.withColumn(dim.fact_key, checked).drop(side[dim.key])
    return fact
