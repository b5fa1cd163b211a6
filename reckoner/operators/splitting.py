"""Time split and leave-one-out split, with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckoner.functions.scalars import micros
from reckoner.operators.ordering import durable, scalar

# The shares of the time span held out for validation and test.
VAL_FRACTION = 0.08
TEST_FRACTION = 0.08


def time_bounds(interactions: DataFrame, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION) -> DataFrame:
    """One row with the span and both cut points, in microseconds."""
    span = interactions.agg(F.min(micros(F.col("ts"))).alias("lo"), F.max(micros(F.col("ts"))).alias("hi"))
    width = F.col("hi") - F.col("lo")
    return span.select(
        "lo",
        "hi",
        (F.col("hi") - F.lit(val_frac + test_frac) * width).alias("val_start"),
        (F.col("hi") - F.lit(test_frac) * width).alias("test_start"),
    )


def time_split(interactions: DataFrame, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION) -> DataFrame:
    """Label every row train, val or test. The cut points are scalar subqueries over the same table."""
    bounds = time_bounds(interactions, val_frac, test_frac)
    us = micros(F.col("ts"))
    return interactions.withColumn(
        "split",
        F.when(us < scalar(bounds, "val_start"), "train").when(us < scalar(bounds, "test_start"), "val").otherwise("test"),
    )


def split_stats(split: DataFrame) -> DataFrame:
    """Rows, users, bounds and cold users/items per split, one row each."""
    per_split = split.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
        F.min(micros(F.col("ts"))).alias("first_us"),
        F.max(micros(F.col("ts"))).alias("last_us"),
    )
    cold_users = _cold_counts(split, "user_id", "cold_users")
    cold_items = _cold_counts(split, "item_id", "cold_items")
    return (
        per_split.join(cold_users, "split", "left")
        .join(cold_items, "split", "left")
        .fillna(0, ["cold_users", "cold_items"])
    )


def _cold_counts(split: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys of val and test that never occur in train: one aggregation per key, no self-join."""
    flags = split.groupBy(key).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    )
    cold = flags.where(F.col("train") == 0).agg(F.sum("val").alias("val"), F.sum("test").alias("test"))
    return cold.select(F.expr(f"stack(2, 'val', val, 'test', test) as (split, {name})"))


def first_interactions(interactions: DataFrame) -> DataFrame:
    """Distinct (user, item) with the earliest row of each, by partial aggregation."""
    first = F.min(F.struct("ts", "k1", "k2")).alias("_first")
    return interactions.groupBy("user_id", "item_id").agg(first).select("user_id", "item_id", "_first.*")


def loo_split(interactions: DataFrame, min_items: int = 3) -> DataFrame:
    """Leave-one-out labels over first interactions: newest item test, second newest val, rest train.

    Only the two newest rows per user go through a window, and its row limit applies before the shuffle;
    the other rows meet their user's two cut keys in a join, which adaptive execution splits for a hot user. The first
    interactions are staged: their sorted aggregation runs once for all three uses, and in tasks of its own.
    """
    pairs = durable(first_interactions(interactions))
    key = F.struct("ts", "k1", "k2", "item_id")
    newest_first = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in ("ts", "k1", "k2", "item_id")])
    last_two = pairs.withColumn("_rn", F.row_number().over(newest_first)).where(F.col("_rn") <= 2)
    cuts = last_two.groupBy("user_id").agg(F.max(key).alias("_last"), F.min(key).alias("_previous"))
    sizes = pairs.groupBy("user_id").agg(F.count("*").alias("n_items")).where(F.col("n_items") >= min_items)
    labelled = pairs.join(cuts.join(sizes, "user_id"), "user_id")
    return labelled.withColumn(
        "split", F.when(key == F.col("_last"), "test").when(key == F.col("_previous"), "val").otherwise("train")
    ).select("user_id", "item_id", "ts", "k1", "k2", "split")


def loo_context(loo: DataFrame, split: str) -> DataFrame:
    """History available when predicting ``split``: train rows, plus the val item for test."""
    return loo.where(F.col("split").isin("train", "val") if split == "test" else F.col("split") == "train")


def loo_stats(loo: DataFrame) -> DataFrame:
    """Users, rows, train-length statistics and cold-target shares in one row."""
    lengths = loo.groupBy("user_id").agg(F.count_if(F.col("split") == "train").alias("n_train"))
    shape = lengths.agg(
        F.count("*").alias("n_users"),
        F.sum("n_train").alias("train_rows"),
        F.median("n_train").alias("median_len"),
        F.avg("n_train").alias("mean_len"),
        F.percentile("n_train", F.lit(0.95)).alias("p95_len"),
    )
    items = loo.groupBy("item_id").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    )
    cold = items.agg(
        F.sum(F.when(F.col("train") == 0, F.col("val")).otherwise(0)).alias("cold_val"),
        F.sum(F.when((F.col("train") == 0) & (F.col("val") == 0), F.col("test")).otherwise(0)).alias("cold_test"),
        F.sum("val").alias("n_val"),
        F.sum("test").alias("n_test"),
    )
    cold = cold.select(
        F.try_divide(100.0 * F.col("cold_val"), "n_val").alias("pct_cold_val"),
        F.try_divide(100.0 * F.col("cold_test"), "n_test").alias("pct_cold_test"),
    )
    return shape.withColumns({c: scalar(cold, c) for c in cold.columns})


def labelled_union(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    return (
        train.withColumn("split", F.lit("train"))
        .unionByName(val.withColumn("split", F.lit("val")))
        .unionByName(test.withColumn("split", F.lit("test")))
    )
