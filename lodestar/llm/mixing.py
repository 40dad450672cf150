"""Mixing sources to target weights by pivotal dependent rounding.

Method. Each source has a target; a document of it is due target / source size copies: a whole part that it gets for
certain, and a fraction p. Pairs of fractions are settled by the pivotal step: mass moves from one document to the other at
random, weighted by size so that the words (size times p) of the pair stay the same and each p keeps its expectation,
until one of them is 0 or 1. What is left of a bucket is one fraction per source; buckets are combined by FAN_IN at a
time through a reduction tree, and only the root's last fraction of a source is rounded on its own. The words taken from a
source so differ from its target by less than one document.

Scale. Only doc_id, source and size are shuffled, once, into buckets by hash of all three, so a source that holds a third
of the rows is spread over all buckets, and so are rows without a doc_id; a task streams its sorted bucket and holds one open fraction per source. The tree's
next levels hold one row per bucket and source. The table of sources (not of documents) goes through the driver: more than MAX_SOURCES are an error.

Reruns agree: bucket numbers depend on the number of rows, order on the rows themselves, and random numbers on the
seed, tree level and bucket; partitions and executors play no part.

Defined cases. Null texts and texts without a word have size 0: they take 0 words, whatever their copies. A null source
is a source of its own, last in order. Null and repeated doc_ids are rows like any others. A source whose size is 0 has
target 0. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, read_table, text_or_empty

#: Rows in a bucket of the tree's lowest level, and buckets that one bucket of the next level takes.
BUCKET_ROWS, FAN_IN = 50_000, 64
#: Weights by order of source, repeating; most copies of a document.
WEIGHTS, MAX_COPIES, SEED = (5, 2, 1), 3, 20_240_601
#: Sources at most: their names and sizes pass through the driver.
MAX_SOURCES = 1_000_000

_ROW = "doc_id long, source string, size long, source_size long, target double, copies long, p double, node long"
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _ROW.split(", "))])


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its own size; what is over goes to the rest by weight."""
    target, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return target


def pivot(s1: float, p1: float, s2: float, p2: float, u: float) -> tuple[float, float]:
    """One pivotal step: s1 p1 + s2 p2 stays, both expectations stay, one of the two becomes 0 or 1."""
    r = s2 / s1
    up, down = min(1 - p1, r * p2), min(p1, r * (1 - p2))
    if u * (up + down) < down:  # the first gains
        return (1.0, p2 - up / r) if 1 - p1 <= r * p2 else (p1 + up, 0.0)
    return (0.0, p2 + down / r) if p1 <= r * (1 - p2) else (p1 - down, 1.0)


def _settle(batches: Iterator[pa.RecordBatch], level: int, seed: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and source; all come out, with p 0 or 1 except one open row per node and source (none if last)."""
    node = source = held = None
    first = True
    for batch in batches:
        out = []
        for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if first or row[7] != node or row[1] != source:
                if held is not None:
                    out.append(_closed(held, last, final))
                    held = None
                if first or row[7] != node:
                    rng, draws = np.random.default_rng([seed, level, row[7]]), iter(())
                    final = np.random.default_rng([seed, level, row[7], 1])
                node, source, first = row[7], row[1], False
            if not 0 < row[6] < 1 or row[2] <= 0:
                row[6] = float(row[6] >= 1)
                out.append(row)
                continue
            if held is None:
                held = row
                continue
            if (u := next(draws, None)) is None:
                draws = iter(rng.random(1024).tolist())
                u = next(draws)
            held[6], row[6] = map(_snapped, pivot(held[2], held[6], row[2], row[6], u))
            if 0 < row[6] < 1:
                held, row = row, held
            out.append(row)
            if not 0 < held[6] < 1:
                out.append(held)
                held = None
        if out:
            yield _batch(out)
    if held is not None:
        yield _batch([_closed(held, last, final)])


def _closed(row: list, last: bool, final: np.random.Generator) -> list:
    if last:
        row[6] = float(final.random() < row[6])
    return row


def _snapped(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target and copies (a whole number up to max_copies)."""
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(key).alias("doc_id"), "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    n = sum(r["rows"] for r in totals)
    targets = water_fill([r["source_size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], max_copies)
    table = spark.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(totals, targets, strict=True)], "source string, source_size long, target double")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = max(1, -(-n // bucket_rows))
    rows = (
        sized.join(table, sized["source"].eqNullSafe(table["source"]))
        .select("doc_id", sized["source"], "size", "source_size", "target", F.floor(ratio).alias("copies"), (ratio - F.floor(ratio)).alias("p"), F.pmod(F.xxhash64("doc_id", sized["source"], "size"), F.lit(buckets)).alias("node"))
    )
    done, level = [], 0
    while True:
        last = buckets == 1

        def settle(batches, level=level, last=last):
            return _settle(batches, level, seed, last)

        settled = cut(rows.repartition("node").sortWithinPartitions("node", "source", "doc_id", "size").mapInArrow(settle, _ROW), "mixed")
        done.append(settled.where("p = 0 or p = 1"))
        if last:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        rows = settled.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", (F.col("copies") + F.col("p").cast("long")).alias("copies"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
