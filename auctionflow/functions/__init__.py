"""Column expressions shared by the operators. Prices and times stay integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(num: Column, den: Column) -> Column:
    """Truncating integer division, the only kind used for prices and averages."""
    return F.call_function("div", num, den)


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def slide_end(t: Column, slide: int) -> Column:
    """End of the slide that holds integer time `t`; slides start at multiples of `slide`."""
    return (int_div(t, F.lit(slide).cast("bigint")) + 1) * slide


def start_of_day(t: str) -> Column:
    """Midnight before a zone-less time, without the session's zone."""
    return F.col(t).cast("date").cast("timestamp_ntz")


def words(text: Column) -> Column:
    """The whitespace-separated words of a text, without empty strings."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_prime(n: Column) -> Column:
    """Trial division up to the square root, tested without leaving the JVM."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    divisors = F.when(n >= 4, F.sequence(F.lit(2).cast("bigint"), root)).otherwise(
        F.array().cast("array<bigint>"))
    return (n >= 2) & ~F.exists(divisors, lambda d: n % d == 0)


def seconds(n: int | float) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")
