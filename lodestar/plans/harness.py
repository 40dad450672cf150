"""Runs of queries under profiles: repetitions, time limits, result checks, a run log and reports over it."""

from __future__ import annotations

import os
import re
import signal
import subprocess
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Catalog
from . import profiles
from .profiles import ExecProfile
from .verify import bag_difference

OKAY, WRONG_RESULTS, UNCHECKED, OOM, EXCEPT, TIMEOUT, CRASH = "OKAY", "WRONG_RESULTS", "UNCHECKED", "OOM", "EXCEPT", "TIMEOUT", "CRASH"


@dataclass
class Run:
    query: str
    profile: str
    threads: int
    repetition: int
    status: str
    seconds: float
    input_rows: int | None = None


def limited(spark: SparkSession, action: Callable[[], None], timeout: float) -> tuple[str, float]:
    """Status and seconds of an action whose Spark jobs are cancelled after the time limit."""
    group, late = uuid.uuid4().hex, threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(timeout, cancel)
    spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
    timer.start()
    began = time.perf_counter()
    try:
        action()
        status = UNCHECKED
    except (Py4JError, ConnectionError) as e:
        status = TIMEOUT if late.is_set() else OOM if "OutOfMemoryError" in str(e) else CRASH if isinstance(e, ConnectionError) else EXCEPT
    except Exception as e:  # noqa: BLE001  a failed query is a result of the harness
        status = TIMEOUT if late.is_set() else OOM if "OutOfMemoryError" in str(e) else EXCEPT
    finally:
        timer.cancel()
        spark.sparkContext._jsc.clearJobGroup()
    return status, time.perf_counter() - began


def consume(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def run(
    spark: SparkSession,
    name: str,
    query: Callable[[], DataFrame],
    profile: ExecProfile = profiles.BASE[0],
    repetitions: int = 5,
    timeout: float = 30,
    expected: DataFrame | None = None,
    input_rows: int | None = None,
) -> list[Run]:
    """A warm-up, which is checked if there are expected rows, and repetitions that are timed."""
    threads, out = spark.sparkContext.defaultParallelism, []
    with profile.on(spark):
        status, seconds = limited(spark, lambda: consume(query()), timeout)
        if status == UNCHECKED and expected is not None:
            status = WRONG_RESULTS if bag_difference(query(), expected, 1) else OKAY
        if status not in (OKAY, UNCHECKED):
            return [Run(name, profile.name, threads, 0, status, seconds, input_rows)]
        for k in range(repetitions):
            again, seconds = limited(spark, lambda: consume(query()), timeout)
            out.append(Run(name, profile.name, threads, k, status if again == UNCHECKED else again, seconds, input_rows))
    return out


def isolated(query: str, folder: str, threads: int = 8, timeout: float = 120, command: tuple[str, ...] = (sys.executable, "-m", "lodestar")) -> Run:
    """A query of the catalogue in a process of its own, which may crash or hang without harm to this one."""
    args = [*command, "--data", folder, "--queries", query, "--threads", str(threads), "--hot-runs", "1", "--no-result", "--timeout", str(timeout)]
    root, began = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), time.perf_counter()
    child = subprocess.Popen(args, cwd=root, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, start_new_session=True)
    try:
        said, _ = child.communicate(timeout=timeout)
        told = re.findall(rf"\| {re.escape(query)} \|[^|]*\|[^|]*\| (\w+) \|", said)
        status = told[-1] if told else OOM if "OutOfMemoryError" in said else CRASH if child.returncode else EXCEPT
    except subprocess.TimeoutExpired:
        os.killpg(child.pid, signal.SIGKILL)  # its JVM too
        child.communicate()
        status = TIMEOUT
    return Run(query, "isolated", threads, 0, status, time.perf_counter() - began)


def input_rows(catalog: Catalog, tables: Iterable[str]) -> int:
    return sum(catalog[t].count() for t in tables)


def best(runs: list[Run]) -> float:
    good = [r.seconds for r in runs if r.status in (OKAY, UNCHECKED)]
    return min(good, default=float("inf"))


def explore(spark: SparkSession, name: str, query: Callable[[], DataFrame], mode: str = "base", samples: int = 8, seed: int = 0, repetitions: int = 3, timeout: float = 30) -> list[Run]:
    """Runs of a query under many profiles. base: the named ones; step: from the best named one, better neighbours setting by setting;
    full: a random sample of the grid. Each is checked against the default's rows."""
    expected = query()

    def tried(p: ExecProfile) -> list[Run]:
        return run(spark, name, query, p, repetitions, timeout, expected)

    if mode == "full":
        return [r for p in profiles.sampled(samples, seed) for r in tried(p)]
    by = {p: tried(p) for p in profiles.BASE} if mode in ("base", "step") else None
    if by is None:
        raise ValueError(f"no mode {mode!r}")
    runs = [r for rs in by.values() for r in rs]
    if mode == "step":
        top = min(by, key=lambda p: best(by[p]))
        least, improved = best(by[top]), True
        while improved:
            improved = False
            for p in profiles.neighbours(top):
                runs += (found := tried(p))
                if best(found) < 0.95 * least:
                    top, least, improved = p, best(found), True
                    break
    return runs


def report(runs: list[Run]) -> str:
    """A table of the fastest, mean and slowest time, and input rows a second, of each query, profile and number of threads."""
    groups: dict[tuple, list[Run]] = {}
    for r in runs:
        groups.setdefault((r.query, r.profile, r.threads), []).append(r)
    lines = ["| query | profile | threads | status | min s | avg s | max s | rows/s |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for (query, profile, threads), rs in groups.items():
        s = [r.seconds for r in rs]
        mean = sum(s) / len(s)
        rate = f"{rs[0].input_rows / mean:.0f}" if rs[0].input_rows else "-"
        status = next((r.status for r in rs if r.status not in (OKAY, UNCHECKED)), rs[0].status)
        lines.append(f"| {query} | {profile} | {threads} | {status} | {min(s):.3f} | {mean:.3f} | {max(s):.3f} | {rate} |")
    return "\n".join(lines)


def as_rows(runs: list[Run]) -> list[dict]:
    return [asdict(r) for r in runs]
