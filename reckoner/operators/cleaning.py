"""Cleaning, projection and row filters on raw logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import contains_ignore_case, millis_to_ts
from reckoner.operators.ordering import newest


def retail_row_is_valid() -> Column:
    """Known customer, not a cancellation, positive quantity."""
    return (
        F.col("CustomerID").isNotNull() & ~F.col("InvoiceNo").cast("string").startswith("C") & (F.col("Quantity") > 0)
    )


# Text forms of invoice dates beside ISO: month first, as in the public retail file.
DATE_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy")


def parsed_date(column: str) -> Column:
    """A timestamp from a timestamp, a date or text in ISO form or one of ``DATE_FORMATS``; other text becomes null."""
    text = F.col(column).cast("string")
    return F.coalesce(F.col(column).try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def clean_retail(raw: DataFrame) -> DataFrame:
    return raw.where(retail_row_is_valid()).withColumn("InvoiceDate", parsed_date("InvoiceDate"))


def share_kept(raw: DataFrame, condition: Column) -> DataFrame:
    """Rows before, rows kept and their ratio in one pass."""
    kept = F.count_if(condition)
    return raw.agg(
        F.count("*").alias("rows_in"), kept.alias("rows_kept"), F.try_divide(kept, F.count("*")).alias("share_kept")
    )


def clean_ratings(raw: DataFrame, order_by: list[str]) -> DataFrame:
    """Drop rows with a null key and keep the first of every (user, item, time).

    ``min_by`` aggregates on the map side, so copies of one key collapse before the shuffle.
    """
    keys = ["user_id", "parent_asin", "timestamp"]
    rest = [c for c in raw.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")
    return raw.dropna(subset=keys).groupBy(*keys).agg(first).select(*keys, "_first.*")


def with_timestamp(ratings: DataFrame, millis: str = "timestamp", out: str = "ts") -> DataFrame:
    return ratings.withColumn(out, millis_to_ts(F.col(millis)))


def with_derived_constants(ratings: DataFrame, row_label: Column) -> DataFrame:
    """Ratings have no basket: quantity 1 and an invoice id made from the row label."""
    return ratings.withColumn("quantity", F.lit(1)).withColumn("invoice_id", F.concat(F.lit("r"), row_label))


def fill_titles(df: DataFrame, column: str, sentinel: str = "UNKNOWN") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(sentinel)))


def ordered_layout(interactions: DataFrame) -> DataFrame:
    """(user, time) layout for writing. Range partitions split a hot user over several files."""
    order = ["user_id", "ts", "k1", "k2", "item_id"]
    return interactions.repartitionByRange(*order).sortWithinPartitions(*order)


def search_titles(catalog: DataFrame, text: str, column: str = "description") -> DataFrame:
    return catalog.where(contains_ignore_case(F.col(column), text))


def users_with_count_between(interactions: DataFrame, low: int, high: int) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))


def keyword_users(interactions: DataFrame, catalog: DataFrame, word: str, min_items: int = 4) -> DataFrame:
    """Users with at least ``min_items`` rows whose newest ``min_items`` titles all contain the word."""
    last = newest(interactions.select("user_id", "ts", "k1", "k2", "item_id"), "user_id", ["ts", "k1", "k2", "item_id"], min_items)
    titled = last.join(catalog.select("item_id", "description"), "item_id")
    hit = contains_ignore_case(F.col("description"), word)
    return (
        titled.groupBy("user_id")
        .agg(F.count_if(hit).alias("n_matching"))
        .where(F.col("n_matching") == min_items)
        .select("user_id")
    )


def summary(interactions: DataFrame) -> DataFrame:
    return interactions.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
    )
