"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv", "orc", "json")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "parquet", null_mark: str | None = None) -> DataFrame:
    """Read a table with an explicit schema (self-describing formats may omit it).

    ``null_mark`` is the text that stands for missing in CSV, e.g. ``'.'``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema: inference would scan the data twice")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if null_mark is not None:
            reader = reader.option("nullValue", null_mark)
    return reader.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Write, replacing the target."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def drop_work(spark: SparkSession, *views: str) -> None:
    """Drop named temporary views, or all of them when none is named."""
    names = views or [t.name for t in spark.catalog.listTables() if t.isTemporary]
    for name in names:
        spark.catalog.dropTempView(name)


def materialize(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Fix ``df`` for repeated passes; returns it and a function that frees it.

    Where the cluster names a shared folder (``spark.checkpoint.dir``) the rows
    are written there as a table first, so blocks lost with an executor are read
    back instead of being recomputed from the sources. The cached copy serves
    the passes. Freeing drops both, so do it only when no result still to be
    evaluated reads ``df``.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared}/rows-{uuid.uuid4().hex}" if shared else None
    if path:
        df.write.parquet(path)
        df = spark.read.schema(df.schema).parquet(path)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)

    def release() -> None:
        kept.unpersist()
        if path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return kept, release
