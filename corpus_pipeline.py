"""The corpus pipeline: stages that each read what the one before kept, from documents to packed sequences.

All but the last return the columns of documents, whatever other columns these have and however they are named. Rows are told apart by
file and row index where doc_ids may be null or repeat; defined cases are those of the operators: each stage's docstring names what it
decides on them. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import classifier, exact_dedup, mixing, packing, simhash
from lodestar.llm.common import cut, locator, read_table, scope, settle


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose (file, row) rows has; their own columns may have any names."""
    located = docs.select(F.struct("*").alias("own"), *locator(docs))
    return located.join(rows.select("file", "row"), ["file", "row"], "left_semi").select("own.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; null and empty texts are scored like any others."""
    score = classifier.scorer(spark, classifier.train(docs, read_table(spark, sf_dir, "labels")))
    settle(spark)
    scored = docs.select(F.struct("*").alias("own"), score(F.col("text")).alias("score"))
    return scored.where(F.col("score") >= classifier.THRESHOLD).select("own.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id (null last)."""
    found = exact_dedup.exact_dedup(docs)
    settle(spark)
    return _only(docs, found.where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8), that with the smallest doc_id (null last)."""
    groups = simhash.near_copies(docs.select("doc_id", "text", *locator(docs)))
    settle(spark)
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first"))
    return _only(docs, first.select("first.file", "first.row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, or up to three times). Rows that repeat with their doc_id and text are taken
    alike; a null source is a source of its own; null and empty texts have size 0, and are taken as often as every document of their source is for certain."""
    keyed = docs.select(F.struct("*").alias("own"), F.xxhash64("doc_id", "text").alias("key"), "source", "text")
    mixed = mixing.mix(keyed.select("key", "source", "text"), key="key")
    copies = mixed.groupBy("key").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    return keyed.select("key", "own").join(copies, "key").select("own", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("own.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of all that the mix took; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: No SQL: the classifier, the random rounding and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with scope(spark) as keep_last:
        for name, stage in STAGES[:-1]:
            with scope(spark) as keep:
                docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                keep(docs)
        keep_last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
