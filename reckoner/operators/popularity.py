"""Popularity retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators.compose import top_unseen
from reckoner.operators.ordering import global_index

POPULARITY_LIST = 0


def popularity(train: DataFrame) -> DataFrame:
    """Items with their count and rank, most popular first, smaller id on ties."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    index = global_index(counts, [F.col("n").desc(), F.col("item_id")], "_i")
    return index.select("item_id", "n", (F.col("_i") + 1).alias("rank"))


def seen_pairs(train: DataFrame) -> DataFrame:
    return train.select("user_id", "item_id").distinct()


def popularity_list(popular: DataFrame) -> DataFrame:
    """The popularity ranking as the single list of ``top_unseen``."""
    return popular.select(
        F.lit(POPULARITY_LIST).alias("list_id"), "rank", "item_id", F.col("n").cast("double").alias("score")
    )


def popularity_topk(popular: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The k most popular unseen items of every user."""
    assigned = users.select("user_id").withColumn("list_id", F.lit(POPULARITY_LIST))
    return top_unseen(assigned, popularity_list(popular), seen, k)


def cold_users(users: DataFrame, train: DataFrame) -> DataFrame:
    """Users without any train row."""
    return users.select("user_id").distinct().join(train.select("user_id").distinct(), "user_id", "left_anti")
