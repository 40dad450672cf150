"""Exact deduplication by stateful streaming. DataFrame and SQL functions only.

Method. Every document becomes a keyed row: the SHA-256 of its normalised text, its doc_id and a content
locator (file and row index, which find its bytes again). The keyed rows are a stream; a streaming aggregation
with RocksDB state, without watermark and so without expiry, keeps for each digest the stable identifier (the
smallest doc_id), that row's locator, the locator of the row that came first, and the number of rows. Later arrivals continue from the same state. Digests
that an arrival hit are checked on their full bytes, those of the arrival and those that the first row's locator finds: the smallest
and the largest normalised text of a digest must be the same string. Where they aren't, the digest collided and its rows are grouped by the bytes.

Scale. The text is read twice and never shuffled as a whole: only digests that have hits are aggregated, found by
a bitmap of fixed size (so its broadcast has a proven bound; as it fills up, it only filters less). Aggregations combine within tasks first, so a text that a third of all rows share sends one row a task.

Defined cases. A null text counts as empty. Null doc_ids sort last and are kept only if no row of the group has one;
keep_id is then null. Rows that repeat in full are separate members of their group; one of them stays (the first by
file and row). An empty table gives an empty result. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, locator, prefiltered, read_table, scope, scratch, text_or_empty

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes
}


def normalised(col: str = "text") -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


_LEAST = "struct<no_id: boolean, doc_id: long, file: string, row: long>"
_ELDEST = "struct<arrival: int, file: string, row: long>"


def _least() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("least")


class StreamingDedup:
    """Keyed state over all documents seen so far, kept below `path` in the shared folder.

    ingest() takes a batch of documents (doc_id, text, read from files), brings the state up to date, and checks the bytes of what was hit;
    groups() and assigned() tell what the state says. The files must stay where they were: the state holds locators, not texts. sources: the
    earlier batches, for a store that continues one of another session."""

    def __init__(self, spark: SparkSession, path: str, digest=sha256, sources: Sequence[DataFrame] = ()):
        self.spark, self.path, self.digest, self.sources = spark, path, digest, list(sources)

    def _located(self, docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", normalised().alias("norm"), *locator(docs))
        return rows.withColumn("digest", self.digest(F.col("norm")))

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self._located, self.sources))

    def ingest(self, docs: DataFrame) -> None:
        arrival = len(self.sources)
        self.sources.append(docs)
        self._located(docs).select("doc_id", "digest", "file", "row", F.lit(arrival).alias("arrival")).write.mode("append").parquet(f"{self.path}/keyed")
        self._advance()
        self._check(docs, arrival)

    def _advance(self) -> None:
        spark, before = self.spark, {}
        for k, v in _ROCKS.items():
            before[k] = spark.conf.get(k, None)
            spark.conf.set(k, v)
        try:
            arrivals = spark.readStream.schema(self.keyed().schema).parquet(f"{self.path}/keyed")
            state = arrivals.groupBy("digest").agg(_least(), F.min(F.struct("arrival", "file", "row")).alias("eldest"), F.count(F.lit(1)).alias("size"))
            query = (
                state.writeStream.outputMode("update")
                .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.path}/state/batch={n}"))
                .option("checkpointLocation", f"{self.path}/progress")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def _check(self, docs: DataFrame, arrival: int) -> None:
        """Full bytes of every digest that this arrival hit: its own texts, and that of the digest's first document by its locator."""
        with scope(self.spark):
            hits = self._state().where("size > 1").select("digest", "eldest")
            if arrival:
                mine = self.keyed().where(F.col("arrival") == arrival).select("digest").distinct()
                hits = hits.join(mine, "digest", "left_semi")
            hits = cut(hits, "hits")
            norms = docs.select(normalised().alias("norm")).select(self.digest(F.col("norm")).alias("digest"), "norm")
            texts = prefiltered(norms, hits, ["digest"])
            if arrival:
                first = hits.where(F.col("eldest.arrival") < arrival).select("digest", "eldest.file", "eldest.row")
                earlier = reduce(DataFrame.unionByName, [d.select(normalised().alias("norm"), *locator(d)) for d in self.sources[:-1]])
                texts = texts.unionByName(prefiltered(earlier, first, ["file", "row"]).join(first, ["file", "row"]).select("digest", "norm"))
            ends = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
            ends.where("lo <> hi").select("digest").write.mode("append").parquet(f"{self.path}/collided")

    def keyed(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, digest binary, file string, row long, arrival int").parquet(f"{self.path}/keyed")

    def collided(self) -> DataFrame:
        """Digests that differing texts share."""
        return self.spark.read.schema("digest binary").parquet(f"{self.path}/collided").distinct()

    def _state(self) -> DataFrame:
        """The latest state of each digest; an update replaces what earlier batches said."""
        state = f"digest binary, least {_LEAST}, eldest {_ELDEST}, size long, batch int"
        latest = self.spark.read.schema(state).parquet(f"{self.path}/state")
        return latest.groupBy("digest").agg(F.max_by(F.struct("least", "eldest", "size"), "batch").alias("s")).select("digest", "s.*")

    def _grouped(self) -> tuple[DataFrame, DataFrame, list[str]]:
        """Groups (digest, least, size), rows (doc_id, digest, file, row), and what joins them: the digest, and the text itself where digests
        collided (empty elsewhere)."""
        groups, rows = self._state().select("digest", "least", "size"), self.keyed().drop("arrival")
        collided = cut(self.collided(), "collided")
        if collided.isEmpty():
            return groups, rows, ["digest"]
        split = cut(self._all().join(collided, "digest", "left_semi").select("doc_id", "digest", "file", "row", F.col("norm").alias("variant")), "split")
        exact = split.groupBy("digest", "variant").agg(_least(), F.count(F.lit(1)).alias("size"))
        whole = groups.join(collided, "digest", "left_anti").select("digest", F.lit("").alias("variant"), "least", "size")
        plain = rows.join(collided, "digest", "left_anti").withColumn("variant", F.lit(""))
        return whole.unionByName(exact), plain.unionByName(split.select(plain.columns)), ["digest", "variant"]

    def groups(self) -> DataFrame:
        """digest, least (doc_id, file, row) and size of each group of equal texts."""
        return self._grouped()[0].select("digest", "least", "size")

    def assigned(self) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its locator (file, row)."""
        groups, rows, on = self._grouped()
        groups = cut(groups, "groups")  # and so joined by a shuffle of its own, which adaptive execution can split
        out = rows.join(groups, on)
        if self.digest is sha256:
            sha = F.lower(F.hex("digest"))
        else:
            out = out.join(self._all().select("file", "row", F.sha2("norm", 256).alias("sha")), ["file", "row"])
            sha = F.col("sha")
        same = (F.col("file") == F.col("least.file")) & (F.col("row") == F.col("least.row"))
        return out.select("doc_id", F.col("least.doc_id").alias("keep_id"), F.col("size").alias("group_size"), same.alias("kept"), sha.alias("text_sha256"), "file", "row")


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the row's locator (file, row).

    docs must come straight from files (their locators are its content locators)."""
    spark = docs.sparkSession
    store = StreamingDedup(spark, scratch(spark, "exact-dedup"), digest)
    store.ingest(docs)
    return store.assigned()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("file", "row")


ORACLE = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
r as (
  select *, row_number() over (partition by norm order by doc_id nulls last) as k,
         min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size from n)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(norm) as text_sha256 from r
"""
