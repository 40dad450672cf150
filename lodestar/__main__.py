"""Command line: run queries of the catalogue under profiles, check, log and report them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import catalogue, harness, profiles
from .plans.tpch import INPUTS
from .sources.files import Catalog, append_runs, result_lines, write_result


def session(threads: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("lodestar")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m lodestar")
    p.add_argument("--data", default="/root/testdata/sf0.01", help="folder of the tables")
    p.add_argument("--queries", default="j1", help="names, separated by commas; or all")
    p.add_argument("--hot-runs", type=int, default=5)
    p.add_argument("--threads", default="8", help="numbers, separated by commas")
    p.add_argument("--profiles", default="default", help=f"of {', '.join(profiles.BY_NAME)}; or all")
    p.add_argument("--mode", choices=("run", "base", "step", "full"), default="run", help="run the profiles named, or explore")
    p.add_argument("--samples", type=int, default=8, help="profiles that mode full draws")
    p.add_argument("--timeout", type=float, default=30)
    p.add_argument("--explain", action="store_true", help="print the plans")
    p.add_argument("--no-run", action="store_true")
    p.add_argument("--safe", action="store_true", help="run each query in a process of its own")
    p.add_argument("--no-result", action="store_true", help="don't print rows")
    p.add_argument("--compare", help="folder of a Parquet result (a folder a query) to check against")
    p.add_argument("--result", help="folder to write result lines to, a folder a query")
    p.add_argument("--profile-log", help="folder of JSON lines to append runs to")
    a = p.parse_args(args)
    names = sorted(catalogue.QUERIES) if a.queries == "all" else a.queries.split(",")
    if unknown := [n for n in names if n not in catalogue.QUERIES]:
        p.error(f"no query {', '.join(unknown)}")
    if a.safe:
        found = [harness.isolated(n, a.data, int(t), a.timeout) for t in a.threads.split(",") for n in names]
        print(harness.report(found))
        return int(any(r.status not in (harness.OKAY, harness.UNCHECKED) for r in found))
    wanted = list(profiles.BASE) if a.profiles == "all" else [profiles.BY_NAME[n] for n in a.profiles.split(",")]
    runs: list[harness.Run] = []
    for threads in map(int, a.threads.split(",")):
        spark = session(threads)
        catalog = Catalog(spark, a.data)
        for name in names:
            make = lambda name=name: catalogue.QUERIES[name](spark, a.data)
            if a.explain:
                make().explain("formatted")
            if a.no_run:
                continue
            if not a.no_result:
                for r in result_lines(make()).limit(20).collect():
                    print(r["line"])
            if a.result:
                write_result(make(), f"{a.result}/{name}")
            expected = spark.read.parquet(f"{a.compare}/{name}") if a.compare else None
            if a.mode != "run":
                runs += harness.explore(spark, name, make, a.mode, a.samples, repetitions=a.hot_runs, timeout=a.timeout)
                continue
            rows = harness.input_rows(catalog, INPUTS.get(name, ()))
            for profile in wanted:
                runs += harness.run(spark, name, make, profile, a.hot_runs, a.timeout, expected, rows)
        if a.profile_log and runs:
            append_runs(spark, harness.as_rows(runs), a.profile_log)
        if len(a.threads.split(",")) > 1:
            spark.stop()
    print(harness.report(runs))
    return int(any(r.status not in (harness.OKAY, harness.UNCHECKED) for r in runs))


if __name__ == "__main__":
    sys.exit(main())
