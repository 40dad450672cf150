"""Scalar and aggregate expressions over Spark columns; all evaluate on the JVM."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01.
EPOCH_JULIAN_DAY = 2440588


def and_all(*conditions: Column) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def or_all(*conditions: Column) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def contains(text: Column, needle: str) -> Column:
    """Byte substring, without wildcards."""
    return F.contains(text, F.lit(needle))


def contains_in_order(text: Column, first: str, second: str) -> Column:
    """`second` occurs after the first occurrence of `first`."""
    at = F.instr(text, first)
    return (at > 0) & (F.instr(F.substring(text, at + len(first), F.length(text)), second) > 0)


def one_of(column: Column, op: str, *values) -> Column:
    """column op value for any of the values; op: eq, lt, le, gt, ge."""
    if op == "eq":
        return column.isin(*values)
    return or_all(*({"lt": column < v, "le": column <= v, "gt": column > v, "ge": column >= v}[op] for v in values))


def day(text: str) -> Column:
    """A date as the tables' timestamps hold it, so that comparisons reach the scan."""
    return F.lit(f"{text} 00:00:00").cast("timestamp_ntz")


def year(column: Column) -> Column:
    return F.year(column).cast("long")


def julian_day(column: Column) -> Column:
    return (F.unix_date(column.cast("date")) + EPOCH_JULIAN_DAY).cast("long")


def from_julian_day(column: Column) -> Column:
    return F.date_from_unix_date((column - EPOCH_JULIAN_DAY).cast("int"))


def scaled(column: Column, scale: int = 2) -> Column:
    """A money column (double or decimal) as a whole number of its smallest unit; exact for values with that many digits."""
    return F.rint(column.cast("double") * float(10**scale)).cast("long")


def unscaled(column: Column, scale: int, precision: int = 18) -> Column:
    """The decimal that a whole number of smallest units stands for."""
    return (column.cast(f"decimal({precision},0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def exact_sum(column: Column, scale: int) -> Column:
    """The exact sum of whole numbers of smallest units, as decimal(30, scale).

    Two sums of longs (by 20 low bits and the rest) stay in generated code, and can't overflow below 10^12 rows of 10^12."""
    high = F.sum(F.shiftright(column, 20)).cast("decimal(19,0)") * F.lit(1 << 20).cast("decimal(7,0)")
    low = F.sum(column.bitwiseAND((1 << 20) - 1)).cast("decimal(19,0)")
    total = high + low
    return (total * F.lit(Decimal(1).scaleb(-scale)) if scale else total).cast(f"decimal(30,{scale})")


def divide_scaled(a: Column, b: Column) -> Column:
    """Quotient of two numbers of smallest units, truncated toward zero."""
    return F.try_divide(a - F.try_mod(a, b), b).cast("long")


def truncated(column: Column, digits: int) -> Column:
    """A number of smallest units with `digits` fewer digits, truncated toward zero."""
    return divide_scaled(column, F.lit(10**digits))


def hash_of(column: Column) -> Column:
    """A 64-bit hash of a value."""
    return F.xxhash64(column)


def rehash(hashed: Column, column: Column) -> Column:
    """The hash of several values: that of those before, and one more."""
    return F.xxhash64(hashed, column)


def sequence() -> Column:
    """Distinct numbers of rows, rising within a partition; not consecutive."""
    return F.monotonically_increasing_id()


def raw_text(column: Column, kind: str, scale: int = 0) -> Column:
    """A value as plain result lines show it: money in smallest units, dates as Julian days, single characters as codes."""
    if kind == "money":
        return scaled(column, scale).cast("string")
    if kind == "date":
        return julian_day(column).cast("string")
    if kind == "char":
        return F.ascii(column).cast("string")
    return column.cast("string")
