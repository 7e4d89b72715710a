"""Fixed-point money: cents and percents as whole numbers, so that sums don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """A double amount as whole cents (or a rate as whole percents)."""
    return F.round(x * 100).cast("bigint")


def int_div(x: Column, y: int) -> Column:
    """Division of whole numbers, cut towards zero."""
    return F.call_function("div", x, F.lit(y).cast("bigint"))


def times_cents(a: Column, b: Column) -> Column:
    """Product of two fixed-point numbers of two digits, cut to two digits, as scale-2 arithmetic does at every product."""
    return int_div(a * b, 100)
