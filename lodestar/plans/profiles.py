"""Execution profiles: settings that may change how fast a query runs, never what it returns."""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: The settings that can vary, and their values; the first is the default.
GRID = {
    "spark.sql.codegen.wholeStage": ("true", "false"),
    "spark.sql.adaptive.enabled": ("true", "false"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024", "256", "16384"),
    "spark.sql.parquet.enableVectorizedReader": ("true", "false"),
    "spark.sql.autoBroadcastJoinThreshold": ("10485760", "-1"),
    "spark.sql.join.preferSortMergeJoin": ("true", "false"),
    "spark.sql.shuffle.partitions": ("8", "1", "32"),
}


@dataclass(frozen=True)
class ExecProfile:
    name: str
    settings: dict[str, str] = field(default_factory=dict)

    @contextmanager
    def on(self, spark: SparkSession) -> Iterator[None]:
        before = {k: spark.conf.get(k, None) for k in self.settings}
        try:
            for k, v in self.settings.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BASE = (
    ExecProfile("default"),
    ExecProfile("interpreted", {"spark.sql.codegen.wholeStage": "false"}),
    ExecProfile("static", {"spark.sql.adaptive.enabled": "false"}),
    ExecProfile("row-reader", {"spark.sql.parquet.enableVectorizedReader": "false"}),
    ExecProfile("small-batches", {"spark.sql.parquet.columnarReaderBatchSize": "256"}),
    ExecProfile("sort-merge", {"spark.sql.autoBroadcastJoinThreshold": "-1"}),
    ExecProfile("shuffled-hash", {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "false"}),
    ExecProfile("one-partition", {"spark.sql.shuffle.partitions": "1"}),
)
BY_NAME = {p.name: p for p in BASE}


def sampled(n: int, seed: int = 0) -> list[ExecProfile]:
    """n profiles drawn from the grid, the same for the same seed."""
    r = random.Random(seed)
    return [ExecProfile(f"sample-{seed}-{k}", {key: r.choice(values) for key, values in GRID.items()}) for k in range(n)]


def neighbours(profile: ExecProfile) -> list[ExecProfile]:
    """The profiles that differ from this one in one setting."""
    out = []
    for key, values in GRID.items():
        now = profile.settings.get(key, values[0])
        out += [ExecProfile(f"{profile.name}+{key.rsplit('.', 1)[-1]}={v}", profile.settings | {key: v}) for v in values if v != now]
    return out
