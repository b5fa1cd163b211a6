"""Dimension tables and id encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators.ordering import dense_ids


def canonical_value(df: DataFrame, key: str, value: str, default: str = "UNKNOWN") -> DataFrame:
    """Most frequent non-null value per key, smallest value on a tie, ``default`` when all are null.

    Two partial aggregations; no window ever holds the rows of a key.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v"))))
    return counts.groupBy(key).agg(best.alias("_best")).select(key, F.coalesce("_best.v", F.lit(default)).alias(value))


def item_catalog(clean: DataFrame) -> DataFrame:
    titles = canonical_value(clean, "StockCode", "Description")
    ids = dense_ids(titles, "StockCode", "item_id")
    return ids.join(titles, "StockCode").select(
        "item_id", F.col("StockCode").alias("stock_code"), F.col("Description").alias("description")
    )


def user_catalog(clean: DataFrame, key: str = "CustomerID") -> DataFrame:
    keys = clean.select(F.col(key).cast("string").alias("customer_id"))
    return dense_ids(keys, "customer_id", "user_id").select("user_id", "customer_id")


def first_per_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """The first record of every key in the given order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")).select(key, "_first.*")


def attach_lookup(keys: DataFrame, lookup: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Left join with a lookup of unique keys. Spark broadcasts it only below its size threshold."""
    joined = keys.join(lookup, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def encode_ids(df: DataFrame, users: DataFrame, user_key: str, items: DataFrame, item_key: str) -> DataFrame:
    """Replace natural keys by the dense ids of the two catalogues."""
    users = users.select(F.col("customer_id").alias("_user_key"), "user_id")
    items = items.select(F.col("stock_code").alias("_item_key"), "item_id")
    plain = df.withColumnsRenamed({user_key: "_user_key", item_key: "_item_key"})
    plain = plain.withColumn("_user_key", F.col("_user_key").cast("string"))
    return plain.join(users, "_user_key").join(items, "_item_key").drop("_user_key", "_item_key")
