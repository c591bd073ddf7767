"""Helpers that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and \\x09-\\x0D (fixed by the contracts).
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _temporary() -> str:
    """A folder on the driver's machine, gone when its process ends."""
    path = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session takes a temporary folder and any other the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = "file://" + _temporary()
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


#: Of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it.

    Wherever the package is installed on them already, the copy says the same. Arrow batches are bounded in
    bytes as well, for long texts: a worker holds a batch in several forms at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(_temporary(), "gridloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.clear()
    _shipped[app] = path


def release() -> None:
    """Hand memory that allocators hold but nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


_holders: dict[str, dict] = {}


def held_by(operator: str) -> dict:
    """What an operator keeps in a Python worker. A worker outlives its stage: the first use by one operator
    lets go of what the others keep there, so that caches don't add up, and of memory that allocators hold."""
    if operator not in _holders:
        for kept in _holders.values():
            kept.clear()
        _holders.clear()
        release()
        _holders[operator] = {}
    return _holders[operator]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sums_before(df: DataFrame, group: str, at: str, weight: str, out: str, top: int, fan: int = 4096) -> DataFrame:
    """Add column `out`: the sum of weight over the rows of a lower `at` in the group; 0 <= at < top, each once a group.

    Steps of `fan` places are summed up in a window each, and the steps' own sums by the same rule, so that
    no window holds more than `fan` rows, however many a group has.
    """
    df = df.withColumn("_step", F.expr(f"`{at}` div {fan}"))
    before = Window.partitionBy(group, "_step").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
    if top > fan:
        steps = df.groupBy(group, F.col("_step").alias("_at")).agg(F.sum(weight).alias("_total"))
        steps = sums_before(steps, group, "_at", "_total", "_below", -(-top // fan), fan)
        summed = summed.join(steps.select(group, F.col("_at").alias("_step"), F.col("_below").alias("_more")), [group, "_step"]).withColumn(out, F.col(out) + F.col("_more")).drop("_more")
    return summed.drop("_step")


def running_offsets(df: DataFrame, group: str, order: list[str], weight: Column, out: str, rows: int, rows_per_bucket: int = 2048) -> DataFrame:
    """Add column `out`: the sum of weight over the rows that precede each row within its group.

    The order is by a hash bucket of the `order` columns, then by those columns, so that no window
    ever holds a whole group: rows are summed by (group, bucket), the bucket table is summed up in
    steps, and only buckets of about rows_per_bucket rows are sorted. Rows that agree in all
    `order` columns are interchangeable. rows: the number of rows, from which buckets are counted.
    """
    n = max(1, -(-rows // rows_per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n))).withColumn("_weight", weight)
    sums = sums_before(df.groupBy(group, "_bucket").agg(F.sum("_weight").alias("_sum")), group, "_bucket", "_sum", "_base", n)
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return df.join(sums.drop("_sum"), [group, "_bucket"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_bucket", "_weight", "_base", "_inside")
