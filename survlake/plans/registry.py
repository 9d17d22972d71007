"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, ShortType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """One integer width, dates as text, floats rounded (and no negative zero)."""
    def shape(f):
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (ByteType, ShortType, IntegerType, BooleanType)):
            c = c.cast("long")
        elif isinstance(t, DateType):
            c = c.cast("string")
        elif isinstance(t, (DoubleType, FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        return c.alias(f.name)
    return df.select(*[shape(f) for f in df.schema.fields])
