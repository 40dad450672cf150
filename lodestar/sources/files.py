"""Tables from and to files: Parquet folders, `|`-separated text, a column cache, plain result lines, a run log."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Catalog:
    """The tables of a folder by name. An unknown name is an error, never an empty table."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES):
        self.spark, self.folder, self.names = spark, folder, names
        self._found: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"no table {name!r}; there are {', '.join(self.names)}")
        if name not in self._found:  # a catalog lives for one query; reading a schema costs a job
            self._found[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._found[name]

    def session_folder(self) -> str:
        """Where what is derived from this folder's tables, as they are now, lies for the session: in the folder that all executors share."""
        jvm, spark = self.spark.sparkContext._jvm, self.spark
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        state = f"{self.folder} {sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files)}"
        return f"{shared_folder(spark)}/lodestar-{spark.sparkContext.applicationId}-{hashlib.sha1(state.encode()).hexdigest()[:16]}"

    def register(self) -> None:
        """Temporary views, for SQL."""
        for name in self.names:
            self[name].createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _local[name], ignore_errors=True)
    return f"file://{_local[name]}"


_local: dict[str, str] = {}


def read_tbl(spark: SparkSession, path: str, schema: StructType, char_columns: tuple[str, ...] = ()) -> DataFrame:
    """`|`-separated text, a row a line; what follows the last separator is ignored. Leading spaces are stripped from char_columns
    only. A value that doesn't fit its type, or money with more digits than its scale, is an error."""
    fields = schema.fields
    text = StructType([StructField(f.name, StringType()) for f in fields] + [StructField("__rest", StringType())])
    rows = spark.read.schema(text).options(sep="|", header=False, quote="", escape="", mode="PERMISSIVE").csv(path)
    columns = []
    for f in fields:
        c = F.col(f.name)
        if f.name in char_columns:
            c = F.ltrim(c)
        kind = f.dataType.simpleString()
        if kind.startswith("decimal"):
            digits = int(kind.rstrip(")").split(",")[1])
            wrong = F.length(F.regexp_extract(c, r"\.(\d*)$", 1)) > digits
            c = F.when(wrong, F.raise_error(F.concat(F.lit(f"{f.name}: too many digits in "), c))).otherwise(c)
        columns.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def write_tbl(df: DataFrame, path: str) -> None:
    """`|`-separated text with a trailing separator, as read_tbl reads it."""
    df.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A columnar copy of make(), written by the first call and read by later ones; its footers hold each column's range."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def result_lines(df: DataFrame, columns=None) -> DataFrame:
    """Rows as lines of values joined by `|`, one column `line`; columns may replace the plain casts to text."""
    return df.select(F.concat_ws("|", *(columns or [F.col(c).cast("string") for c in df.columns])).alias("line"))


def write_result(df: DataFrame, path: str) -> None:
    result_lines(df).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def append_runs(spark: SparkSession, runs: list[dict], path: str) -> None:
    """The run log: a row for each repetition."""
    schema = "query string, profile string, threads int, repetition int, status string, seconds double, input_rows long"
    spark.createDataFrame([tuple(r.get(n.split()[0]) for n in schema.split(", ")) for r in runs], schema).coalesce(1).write.mode("append").json(path)
