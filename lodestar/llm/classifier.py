"""Quality classifier: Naive Bayes support vectors over n-gram indicators (the model is in nbsvm).

Scale. The model is fitted by one task from at most SAMPLE labelled rows, and at most SAMPLE_BYTES of indicators of theirs (whole texts, reduced
to indicator numbers; about SAMPLE x 4 KB, and of very long texts fewer rows). Scoring reads each text once, without a shuffle; the model's two
tables of BUCKETS doubles (4 MB) are broadcast.

Defined cases. Null and empty texts have no indicator: their score is that of the bias alone. Null doc_ids are scored and count as
held out; labels without a document and null labels are ignored. Without rows of both classes every score is the
smoothed share of label 1. Repeated rows are scored each; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm
from .common import cut, read_table, trim, trimmed
from .labelled import held_out, sampled

#: Labelled rows to fit on, at most, and bytes of their indicators.
SAMPLE, SAMPLE_BYTES = 6000, 128 << 20
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> nbsvm.Model:
    """Fitted on rows that aren't held out; the same for the same rows, whatever their order."""

    def tasks(batches: Iterator[pa.RecordBatch]):
        indicators = nbsvm.Indicators()
        for b in batches:
            grams = [indicators(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary()), b.column(2)], names=["doc_id", "grams", "label"])

    made = cut(sampled(docs, labels, sample).select("doc_id", "text", "label").mapInArrow(trimmed(tasks), "doc_id long, grams binary, label int"), "indicators")
    order = F.xxhash64("doc_id")
    sizes = sorted(made.select(order, F.octet_length("grams")).collect())  # bounded by sample
    if (upto := int(np.searchsorted(np.cumsum([n for _, n in sizes]), sample_bytes, "right"))) < len(sizes):
        made = made.where(order < sizes[upto][0])

    def fit(batches: Iterator[pa.RecordBatch]):
        rows = sorted((r["doc_id"], r["grams"], r["label"]) for b in batches for r in b.to_pylist())
        model = nbsvm.fit([np.frombuffer(g, np.int32) for _, g, _ in rows], np.array([y for *_, y in rows], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        rows.clear()

    # one task's, bounded by sample_bytes; without rows there is no task
    found = made.coalesce(1).mapInArrow(trimmed(fit), "model binary").collect()
    return pickle.loads(found[0][0]) if found else nbsvm.fit([], np.empty(0, int))


def scorer(spark: SparkSession, model: nbsvm.Model):
    """A function from a text column to a score column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indicators, m = nbsvm.Indicators(), shared.value
        for t in texts:
            yield pd.Series([m.score(indicators(x)) for x in t], dtype="float64")
        trim()

    def apply(text: Column) -> Column:
        return score(F.coalesce(text, F.lit("")))

    return apply


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, read_table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
