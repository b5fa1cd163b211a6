"""Numbering rows without ever putting one key, or the whole table, into one task.

A window over a hot key sorts that key in a single task, and a window without keys sorts the whole
table there. The functions below range-partition on (keys, order) instead, so a hot key is spread over
as many partitions as its size asks for, and turn per-partition offsets into positions.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key a single task may sort or collect. Larger keys take the range-partitioned way.
HOT_KEY_ROWS = 1_000_000

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="reckoner-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def stage_owner(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the folders staged within the block when it ends, also after a failure.

    Results must be read or written elsewhere inside the block: their plans read the staged tables. Blocks may be nested;
    a folder belongs to the innermost one. Without a block the folders stay, as a result may still need them.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def owned_by() -> list[str] | None:
    """The innermost ``stage_owner`` block, which deletes what is staged now; None without one."""
    return _owned.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


def at_least_partitions(df: DataFrame, n: int) -> DataFrame:
    """Spread an input of few partitions over ``n``; one that has as many keeps its own and is not shuffled."""
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries run in the block remove their shuffle files when they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame, rows_per_file: int = 0, release: bool = True) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes partition-dependent values for good. Unlike a checkpoint the
    result keeps column pruning and its true size, so later joins can choose a broadcast by size. With ``rows_per_file`` a
    task's rows go into several files of at most so many. The shuffle files behind the table go at once, if ``release`` is kept.
    """
    path = scratch_path(df.sparkSession, "stage")
    with _shuffles_released(df.sparkSession) if release else nullcontext():
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark measures its Arrow batch in bytes after each row, 30 microseconds a row. Tables of short rows go without that: their batches
# are bounded by the number of rows.
SHORT_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": (1 << 31) - 1}


class Rounds:
    """Tables staged round by round. ``drop`` deletes one that no later round reads, so that the disk holds the last ones only."""

    def __init__(self, spark: SparkSession, conf: dict[str, object] | None = None):
        self.spark, self.conf = spark, conf or {}
        self._paths: dict[int, str] = {}

    def stage(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "round")
        before = {key: self.spark.conf.get(key, None) for key in self.conf}
        try:
            for key, value in self.conf.items():
                self.spark.conf.set(key, value)
            with _shuffles_released(self.spark):
                df.write.parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        found = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = path
        return found

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df))
        _delete(self.spark, path)
        owned = _owned.get()
        if owned is not None and path in owned:
            owned.remove(path)


def global_index(df: DataFrame, order_by: list, name: str = "index") -> DataFrame:
    """Number all rows 0..n-1 in the given order. ``order_by`` must be a total order."""
    spread = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    spread = durable(spread.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _LOCAL_BITS)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition, never per record: this window is bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        spread.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, (local + F.col("_before")).cast("long"))
        .drop("_part", "_before", "_mid")
    )


def positions(df: DataFrame, keys: list[str], order_by: list, name: str = "pos") -> DataFrame:
    """0-based position of every row within its key; hot keys stay spread over many tasks."""
    indexed = global_index(df, [*keys, *order_by], "_g")
    start = indexed.groupBy(*keys).agg(F.min("_g").alias("_start"))
    return indexed.join(start, keys).withColumn(name, F.col("_g") - F.col("_start")).drop("_g", "_start")


def dense_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Distinct non-null keys with ids 0..n-1 in key order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return global_index(keys, [F.col(key)], id_col)


def split_hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_KEY_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Separate the rows of keys with more than ``limit`` rows. The second part is None when there are none."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*keys)
    hot = durable(hot)
    if hot.isEmpty():
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def successors(df: DataFrame, key: str, order_by: list[str], value: str, limit: int = HOT_KEY_ROWS) -> DataFrame:
    """Consecutive pairs ``(key, value, next_value)`` in key order."""
    df = df.select(key, *dict.fromkeys([*order_by, value]))
    ordinary, hot = split_hot_keys(df, [key], limit)
    window = Window.partitionBy(key).orderBy(*order_by)
    pairs = (
        ordinary.withColumn("next_value", F.lead(value).over(window))
        .where(F.col("next_value").isNotNull())
        .select(key, F.col(value).alias("value"), "next_value")
    )
    if hot is None:
        return pairs
    indexed = global_index(hot, [key, *order_by], "_g").select(key, value, "_g")
    following = indexed.select(F.col(key).alias("_key"), F.col(value).alias("next_value"), (F.col("_g") - 1).alias("_g"))
    chained = indexed.join(following, "_g").where(F.col(key) == F.col("_key"))
    return pairs.unionByName(chained.select(key, F.col(value).alias("value"), "next_value"))


def newest(df: DataFrame, key: str, order_by: list[str], n: int, age: str = "age") -> DataFrame:
    """The last ``n`` rows of every key with their age, 0 = newest. Partial limits run before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_by]))
    return df.withColumn(age, rank).where(F.col(age) <= n).withColumn(age, F.col(age) - 1)


def scalar(one_row: DataFrame, column: str) -> Column:
    """A value of a one-row table as a column: a scalar subquery, neither a join nor a driver round trip."""
    return one_row.select(column).scalar()
