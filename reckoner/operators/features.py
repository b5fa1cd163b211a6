"""Candidate features for reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import micros
from reckoner.functions.vectors import as_doubles, unit
from reckoner.operators.dotscore import score_listed
from reckoner.operators.ordering import durable, scalar
from reckoner.operators.quantiles import counted_quantiles, value_counts
from reckoner.operators.sequences import history_counts, user_profiles

# Names and order of the ranking features.
FEATURES = (
    "als_score",
    "item_popularity_log",
    "item_price_imputed",
    "has_price",
    "item_recency_norm",
    "content_sim",
    "user_n_interactions_log",
)


def item_popularity(train: DataFrame, catalog: DataFrame) -> DataFrame:
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    return catalog.select("item_id").join(counts, "item_id", "left").select(
        "item_id", F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("item_popularity_log")
    )


def price_medians(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(item_id, _price)`` and one row ``price`` over all rows, from one count of the prices; exact for any number of them."""
    counts = durable(value_counts(train, ["item_id"], "unit_price"))
    overall = counts.groupBy("value").agg(F.sum("n").alias("n"))
    return counted_quantiles(counts, ["item_id"], {"_price": 0.5}), counted_quantiles(overall, [], {"price": 0.5})


def item_prices(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """Median price per item, the row-weighted global median where there is none, and a flag."""
    medians, overall = price_medians(train)
    return catalog.select("item_id").join(medians, "item_id", "left").select(
        "item_id",
        F.coalesce("_price", scalar(overall, "price")).alias("item_price_imputed"),
        F.col("_price").isNotNull().cast("int").alias("has_price"),
    )


def item_recency(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mean interaction time per item within the train span, the row-weighted mean for unseen items."""
    us = micros(F.col("ts"))
    stats = train.agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.avg(us).alias("mean"))
    span = stats.select("lo", "mean", F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).alias("span"))
    means = train.groupBy("item_id").agg(F.avg(us).alias("_mean"))
    filled = F.coalesce("_mean", scalar(span, "mean"))
    return catalog.select("item_id").join(means, "item_id", "left").select(
        "item_id", ((filled - scalar(span, "lo")) / scalar(span, "span")).alias("item_recency_norm")
    )


def item_features(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """All item features, one row per catalogue item."""
    us = micros(F.col("ts"))
    stats = train.agg(
        F.min(us).alias("lo"),
        F.greatest(F.max(us) - F.min(us), F.lit(1)).alias("span"),
        F.avg(us).alias("mean"),
    )
    medians, overall = price_medians(train)
    per_item = train.groupBy("item_id").agg(F.count("*").alias("_n"), F.avg(us).alias("_mean")).join(medians, "item_id", "left")
    recency = (F.coalesce("_mean", scalar(stats, "mean")) - scalar(stats, "lo")) / scalar(stats, "span")
    return catalog.select("item_id").join(per_item, "item_id", "left").select(
        "item_id",
        F.log1p(F.coalesce("_n", F.lit(0)).cast("double")).alias("item_popularity_log"),
        F.coalesce("_price", scalar(overall, "price")).alias("item_price_imputed"),
        F.col("_price").isNotNull().cast("int").alias("has_price"),
        recency.alias("item_recency_norm"),
    )


def content_similarity(candidates: DataFrame, profiles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Cosine of item vector and user profile; 0 for a user without profile or an item without vector."""
    users = profiles.select(F.col("user_id").alias("id"), F.col("profile").alias("vector"))
    items = embeddings.select(F.col("item_id").alias("id"), unit(as_doubles(F.col("embedding"))).alias("vector"))
    pairs = candidates.withColumnsRenamed({"user_id": "id", "item_id": "other"})
    scored = score_listed(users, items, pairs, name="_sim").withColumnsRenamed({"id": "user_id", "other": "item_id"})
    return scored.withColumn("content_sim", F.coalesce("_sim", F.lit(0.0))).select(*candidates.columns, "content_sim")


def candidate_features(recs: DataFrame, train: DataFrame, catalog: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per (user, candidate) with the ranking features; ``rank`` of the retrieval is kept."""
    counts = history_counts(train).withColumnRenamed("n", "_history")
    base = recs.select("user_id", "item_id", "rank", F.col("score").alias("als_score"))
    scored = content_similarity(base, user_profiles(train, embeddings), embeddings)
    joined = scored.join(item_features(train, catalog), "item_id", "left").join(counts, "user_id", "left")
    history = F.log1p(F.coalesce("_history", F.lit(0)).cast("double"))
    return joined.withColumn("user_n_interactions_log", history).select("user_id", "item_id", "rank", *FEATURES)
