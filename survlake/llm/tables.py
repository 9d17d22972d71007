"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"/tmp/survlake-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    gc.collect()  # what the finished job shuffled is no longer needed: let Spark's cleaner see that now
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column: one narrow aggregate, two numbers to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def give_back() -> None:
    """Returns the memory this process no longer uses: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(kernel):
    """``kernel`` (batches to batches) that gives memory back before it begins and when it ends."""
    def run(batches):
        give_back()
        yield from kernel(batches)
        give_back()
    return run


def freed(kernel):
    """A grouped kernel (one table, or two that are grouped alike, to a table) that gives memory back when it ends."""
    if len(signature(kernel).parameters) == 1:
        def one(table: pa.Table) -> pa.Table:
            try:
                return kernel(table)
            finally:
                give_back()
        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return kernel(left, right)
        finally:
            give_back()
    return two


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application: kernels are imported there, so they keep what they cache.

    Where the session sets no bytes for an Arrow batch, batches get 4 MB: Spark's 64 MB
    of text are held several times over, by each task in the JVM and in its worker.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(os.path.dirname(here))
    target = os.path.join(tempfile.mkdtemp(prefix="survlake-"), "survlake_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.dirname(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
