"""Comparison of results as bags of rows, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISMATCHES = 100


def bag_difference(got: DataFrame, want: DataFrame, limit: int = MISMATCHES) -> list[tuple]:
    """Rows that one side has more often than the other, with the surplus of `got` (negative: it lacks them); `limit` of them at most.
    Columns are matched by name, their order is free."""
    names = sorted(want.columns)
    if sorted(got.columns) != names:
        raise ValueError(f"columns differ: {sorted(got.columns)} and {names}")
    sides = [df.select(*names, F.lit(n).alias("__n")) for df, n in ((got, 1), (want, -1))]
    surplus = sides[0].union(sides[1]).groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return [tuple(r) for r in surplus.limit(limit).collect()]


def assert_bag_equal(got: DataFrame, want: DataFrame) -> None:
    if differs := bag_difference(got, want):
        raise AssertionError(f"{len(differs)} rows or more differ: {differs[:5]}")
