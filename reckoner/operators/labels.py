"""Labels, groups and reports for reranker training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators.evaluation import sample_users


def eligible_users(train: DataFrame, val_targets: DataFrame) -> DataFrame:
    """Warm users that have validation targets."""
    return val_targets.select("user_id").distinct().join(train.select("user_id").distinct(), "user_id", "left_semi")


def sample_eligible(train: DataFrame, val_targets: DataFrame, n: int, seed: int) -> DataFrame:
    return sample_users(eligible_users(train, val_targets), n, seed)


def label_candidates(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """1 when the candidate is one of the user's targets."""
    marked = targets.select("user_id", "item_id").distinct().withColumn("_t", F.lit(1))
    return candidates.join(marked, ["user_id", "item_id"], "left").withColumn("label", F.coalesce("_t", F.lit(0))).drop("_t")


def keep_users_with_positive(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates of users for whom retrieval found at least one target."""
    lucky = candidates.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").select("user_id").distinct()
    return candidates.join(lucky, "user_id", "left_semi")


def inject_positives(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Ablation: add missed targets with the list's minimum score. Poisons training; off by default."""
    floors = candidates.groupBy("user_id").agg(F.min("score").alias("score"))
    missed = targets.select("user_id", "item_id").distinct().join(candidates, ["user_id", "item_id"], "left_anti")
    added = missed.join(floors, "user_id").select("user_id", "item_id", "score", F.lit(1).alias("injected"))
    return candidates.select("user_id", "item_id", "score", F.lit(0).alias("injected")).unionByName(added)


def group_sizes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("user_id").agg(F.count("*").alias("group_size"))


def rank_movement(before: DataFrame, after: DataFrame, targets: DataFrame, from_rank: int = 20, to_rank: int = 10) -> DataFrame:
    """Targets that moved from ``from_rank`` or deeper into the first ``to_rank`` places."""
    old = before.select("user_id", "item_id", F.col("rank").alias("rank_before"))
    new = after.where(F.col("rank") <= to_rank).select("user_id", "item_id", F.col("rank").alias("rank_after"))
    moved = new.join(old.where(F.col("rank_before") >= from_rank), ["user_id", "item_id"])
    return moved.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
