"""Predicates that can be named before there is a session: each makes its column expression when it is applied. A null never passes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[], Column]


def closed(c: str, lo, hi) -> Predicate:
    return lambda: F.col(c).between(lo, hi)


def half_open(c: str, lo, hi) -> Predicate:
    return lambda: (F.col(c) >= lo) & (F.col(c) < hi)


def at_most(c: str, hi) -> Predicate:
    return lambda: F.col(c) <= hi


def below(c: str, hi) -> Predicate:
    return lambda: F.col(c) < hi


def at_least(c: str, lo) -> Predicate:
    return lambda: F.col(c) >= lo


def equals(c: str, value) -> Predicate:
    return lambda: F.col(c) == F.lit(value)


def one_of(c: str, values) -> Predicate:
    return lambda: F.col(c).isin(*values)


def starts_with(c: str, prefix: str) -> Predicate:
    return lambda: F.col(c).startswith(prefix)


def greater(a: str, b: str) -> Predicate:
    """Column against column."""
    return lambda: F.col(a) > F.col(b)


def always() -> Predicate:
    return lambda: F.lit(True)


def every(*predicates: Predicate) -> Predicate:
    """Their conjunction; of none, true."""
    return lambda: reduce(and_, (p() for p in predicates)) if predicates else F.lit(True)


def optional(predicate: Predicate, on: bool) -> Predicate:
    return predicate if on else always()


def where(df: DataFrame, *predicates: Predicate) -> DataFrame:
    """The rows for which all hold."""
    return df.where(every(*predicates)())
