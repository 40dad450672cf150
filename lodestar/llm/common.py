"""What the operators of this subpackage share: table access, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the setting is absent and the session is local (in tests) a temporary folder takes its place; on a cluster
    that would be a folder of each machine's own, so there the setting must be there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master: {master})")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the driver ends or clear_scratch() is called."""
    if not _cleared:
        atexit.register(clear_scratch, spark)
        _cleared.append(True)
    path = f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_cleared: list[bool] = []
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:  # the session is over
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote in the shared folder: no result of theirs can be read any more."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}")


@contextmanager
def scope(spark: SparkSession):
    """Gives keep(); what scratch() and cut() made within is deleted at the end, but for what keep() was given: frames of cut(), or paths."""
    mine: list[str] = []
    kept: list[str] = []
    _scopes.append(mine)

    def keep(*made: DataFrame | str) -> None:
        kept.extend(m if isinstance(m, str) else m._scratch for m in made)

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for path in mine:
            if path not in kept:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def locator(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row lies, as columns file and row, for a frame that comes straight from files; a column named _metadata doesn't hide it."""
    at = docs.metadataColumn("_metadata")
    return at.getField("file_path").alias("file"), at.getField("row_index").alias("row")


def cut(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor
    costs a re-read rather than a recomputation. batch_rows: rows that Python functions get at a time."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    now = {_CLEAN: "true"}  # what this job shuffles is of no use once it is written
    if batch_rows:
        now[_BATCH] = str(batch_rows)
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def trim() -> None:
    """Gives memory that Python has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Gives back what the driver doesn't use any more: its heap, the broadcasts and shuffles of frames that are gone, and native memory that was freed.

    Long runs of small jobs otherwise leave it with all the heap it may have, and with as much again that its C library keeps in pieces."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    gc.collect()  # Python's references hold the JVM's frames
    jvm.System.gc()
    with suppress(Exception):  # JVMs without this command keep their freed memory
        kinds = [jvm.java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        signature = gateway.new_array(jvm.java.lang.Class, 4)
        args = gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            signature[i] = kind
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", signature)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    trim()


def trimmed(tasks: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back at its end: workers live on, and several share an executor."""

    def run(batches: Iterator) -> Iterator:
        yield from tasks(batches)
        trim()

    return run


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Bits of the filter that prefiltered() broadcasts: 4 MB.
FILTER_BITS = 1 << 25


def prefiltered(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of df whose cols occur in keys, and some others: a filter before a join, by a bitmap of hashes.

    The bitmap is broadcast, and has FILTER_BITS bits for any input; as it fills up, more rows pass in vain."""
    place = F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))
    bitmap = (
        keys.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
        .groupBy("__bucket")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )
    rows = df.withColumns({"__bucket": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0
    # at most FILTER_BITS / 32768 rows of 4 KB
    return rows.join(F.broadcast(bitmap), "__bucket").where(hit).select(*df.columns)
