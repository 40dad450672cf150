"""Bounded, reproducible samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def label_sample(labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """At most `rows` labelled ids (doc_id, label): those with the least hashes, so the same for any layout of the table. An id with
    several labels has the least of them."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sampled(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, label), one row for each sampled id that docs has; of several texts of an id the least."""
    ids = label_sample(labels, rows, label)
    # ids holds `rows` pairs of numbers at most
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
