"""Query registry: name -> Spark callable, and the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.plans.ctes import with_ctes
from reckoner.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame``; ``sql`` may use any of the named CTEs."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def presented(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain output types: 64-bit integers, rounded doubles, micros for timestamps, text for lists and dates."""
    return df.select(*[_presented(f, digits).alias(f.name) for f in df.schema.fields])


def _presented(field: T.StructField, digits: int) -> Column:
    col, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.IntegerType, T.ShortType, T.LongType)):
        return col.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(col.cast("double"), digits)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return F.array_join(F.transform(col, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))), " ")
        if isinstance(kind.elementType, T.TimestampType):
            return F.array_join(F.transform(col, lambda x: F.unix_micros(x).cast("string")), " ")
        return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")
    return col
