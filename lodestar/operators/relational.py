"""Relational operators over DataFrames: scan, project, select, hash aggregation, hash joins.

They only build logical plans; the choice of join strategy, partial aggregation and pruning is Catalyst's, which broadcasts a side only
below the session's size threshold and splits skewed partitions at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import and_all


def scan(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns reach the reader."""
    return table.select(*columns)


def project(df: DataFrame, *items: str | tuple[str, Column]) -> DataFrame:
    """Exactly the listed items: column names, or (name, expression) pairs, which later items may use by name."""
    names = []
    for item in items:
        if isinstance(item, tuple):
            df = df.withColumn(*item)
            item = item[0]
        names.append(item)
    return df.select(*names)


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold, with all columns."""
    return df.where(and_all(*conditions))


#: Aggregates by name, and how many arguments each takes.
AGGREGATES = {"sum": (F.sum, 1), "count": (lambda: F.count(F.lit(1)), 0), "min": (F.min, 1), "max": (F.max, 1), "product": (F.product, 1), "const1": (lambda: F.max(F.lit(1)), 0)}
#: Folds whose result depends on the order of the rows, which a distributed group hasn't.
ORDERED = ("minus", "divides", "modulus")

Aggregate = Column | tuple


def aggregate(kind: str, *arguments: str | Column) -> Column:
    """An aggregate by its name. Unknown names, and more or fewer arguments than it takes, are errors."""
    if kind in ORDERED:
        raise ValueError(f"{kind} over a group depends on the order of its rows")
    if kind not in AGGREGATES:
        raise ValueError(f"no aggregate {kind!r}; there are {', '.join(AGGREGATES)}")
    make, takes = AGGREGATES[kind]
    if len(arguments) != takes:
        raise ValueError(f"{kind} takes {takes} argument(s), not {len(arguments)}")
    return make(*arguments)


def _named(aggregates: Mapping[str, Aggregate]) -> list[Column]:
    return [(aggregate(*c) if isinstance(c, tuple) else c).alias(n) for n, c in aggregates.items()]


def hash_aggr(df: DataFrame, keys: Sequence[str | Column], aggregates: Mapping[str, Aggregate] | None = None) -> DataFrame:
    """Keys, then aggregates (columns, or names with their arguments); without aggregates the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*_named(aggregates))


def global_aggr(df: DataFrame, aggregates: Mapping[str, Aggregate], empty_row: bool = False) -> DataFrame:
    """One group. Over empty input there is no row, unless empty_row."""
    if empty_row:
        return df.agg(*_named(aggregates))
    out = df.agg(F.count(F.lit(1)).alias("__rows"), *_named(aggregates))
    return out.where("__rows > 0").drop("__rows")


def tap(df: DataFrame, name: str, **metrics: Aggregate) -> tuple[DataFrame, Observation]:
    """The same rows, and what is counted as they stream by (rows, and further aggregates): known once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *_named(metrics)), seen


def _on(probe: DataFrame, build: DataFrame, probe_keys: Sequence[str], build_keys: Sequence[str]) -> Column:
    if len(probe_keys) != len(build_keys) or not probe_keys:
        raise ValueError("as many probe keys as build keys are needed, at least one")
    return and_all(*(probe[p] == build[b] for p, b in zip(probe_keys, build_keys, strict=True)))


def hash_join(probe: DataFrame, probe_keys: Sequence[str], build: DataFrame, build_keys: Sequence[str], payload: Sequence[str] = (), unique_build: bool = False) -> DataFrame:
    """Inner equi-join: all probe columns, the build keys, the build payload.

    unique_build: at most one match for each probe row. Build rows that share their keys are reduced to the one with the least payload."""
    build = build.select(*build_keys, *(c for c in payload if c not in build_keys))
    if unique_build:
        rest = [c for c in build.columns if c not in build_keys]
        build = build.groupBy(*build_keys).agg(F.min(F.struct(*rest)).alias("__p")).select(*build_keys, "__p.*") if rest else build.distinct()
    return probe.join(build, _on(probe, build, probe_keys, build_keys), "inner")


def semi_join(probe: DataFrame, probe_keys: Sequence[str], build: DataFrame, build_keys: Sequence[str]) -> DataFrame:
    """Probe rows that have a match."""
    build = build.select(*build_keys)
    return probe.join(build, _on(probe, build, probe_keys, build_keys), "left_semi")
