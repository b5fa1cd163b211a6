"""Helpers that the corpus operators share: staged tables, document keys, size-checked small tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.operators.ordering import durable
from reckoner.session import apply_runtime_conf, ship_package

__all__ = ["document_key", "pick", "prepared", "shielded", "small", "stage", "table", "unshielded", "with_fields"]

stage = partial(durable, release=False)  # shuffle files go where a query asks for it

# Texts may be long, so a batch that goes to a Python worker is kept small, in rows and in bytes.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}

# Rows of a table that is sent to every task at once. Larger tables take the join that shuffles.
SMALL_ROWS = 50_000


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return ship_package(apply_runtime_conf(spark))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed (new=old). They are found by position and exact name, whatever else there is."""
    return shielded(df).select(*[F.col(f"in{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def shielded(df: DataFrame) -> DataFrame:
    """The columns as ``in0, in1, ...``: no name of the input can clash with one an operator uses."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))])


def unshielded(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """The columns of a shielded table under their own names, and the added ones, which replace input columns so named."""
    taken = {a.lower() for a in added}
    own = [F.col(f"in{i}").alias(name) for i, name in enumerate(names) if name.lower() not in taken]
    return df.select(*own, *added)


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells documents apart: the id, or for rows without one their text."""
    by_text = F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.coalesce(F.col(id_col).cast("string"), by_text)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (of a few numbers or short strings), else as it is.

    ``df`` should be staged: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
