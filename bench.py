"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: a warm-up and five timed runs each; one line of JSON."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestar.__main__ import session  # noqa: E402
from lodestar.plans import catalogue, harness  # noqa: E402
from lodestar.plans.tpch import INPUTS  # noqa: E402
from lodestar.sources.files import Catalog  # noqa: E402

HEADLINE = [*INPUTS, *(n for n in catalogue.QUERIES if n.startswith("ssb_"))]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    catalog, seconds, rates = Catalog(spark, folder), {}, {}
    for name in HEADLINE:
        runs = harness.run(spark, name, lambda name=name: catalogue.QUERIES[name](spark, folder), repetitions=5, timeout=120)
        bad = [r.status for r in runs if r.status != harness.UNCHECKED]
        if bad:
            raise SystemExit(f"{name}: {bad[0]}")
        seconds[name] = round(sum(r.seconds for r in runs) / len(runs), 4)
        if name in INPUTS:
            rates[name] = round(harness.input_rows(catalog, INPUTS[name]) / seconds[name])
    print(json.dumps({"metric": "sum of mean seconds of the headline queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "input_rows_per_sec": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
