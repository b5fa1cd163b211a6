"""Evaluation protocols: user samples, leak guards and full runs over several retrieval tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import sample_key
from reckoner.operators.compose import with_fallback
from reckoner.operators.metrics import METRICS, evaluate, labelled, union_results
from reckoner.operators.popularity import popularity_topk, seen_pairs


def sample_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """Repeatable sample without replacement: the ``n`` smallest md5 keys."""
    distinct = users.select("user_id").distinct()
    return distinct.orderBy(sample_key(seed, F.col("user_id")), "user_id").limit(n)


def warm_sample(targets: DataFrame, train: DataFrame, n: int, seed: int) -> DataFrame:
    """Sample among the users with targets that also have train rows."""
    warm = targets.select("user_id").distinct().join(train.select("user_id").distinct(), "user_id", "left_semi")
    return sample_users(warm, n, seed)


def without_training_users(targets: DataFrame, training_users: DataFrame) -> DataFrame:
    """Leak guard: drop the users a reranker was trained on."""
    return targets.join(training_users.select("user_id").distinct(), "user_id", "left_anti")


def restrict(targets: DataFrame, users: DataFrame) -> DataFrame:
    return targets.join(users.select("user_id"), "user_id", "left_semi")


def sample_report(sample: DataFrame, train: DataFrame) -> DataFrame:
    """Sample size and number of cold users in it."""
    warm = train.select("user_id").distinct().withColumn("_warm", F.lit(1))
    joined = sample.join(warm, "user_id", "left")
    return joined.agg(
        F.count("*").alias("n_sample"),
        F.count_if(F.col("_warm").isNull()).alias("n_cold"),
        (F.count_if(F.col("_warm").isNull()) / F.count("*")).alias("cold_share"),
    )


def run_tiers(
    tiers: dict[str, DataFrame],
    targets: DataFrame,
    split: str,
    fallback: DataFrame | None = None,
    ks: tuple[int, ...] = (10, 20),
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """Score every tier on the same targets; cold users get ``fallback`` in every tier. A tier may be None: skipped."""
    parts = []
    for model, recs in tiers.items():
        if recs is None:
            continue
        served = recs if fallback is None else with_fallback(recs, fallback)
        parts.append(labelled(evaluate(served, targets, ks, metrics), split, model))
    return union_results(parts)


def popularity_baseline(popular: DataFrame, train: DataFrame, targets: DataFrame, split: str, ks=(10, 20), metrics=METRICS) -> DataFrame:
    users = targets.select("user_id").distinct()
    recs = popularity_topk(popular, users, seen_pairs(train), max(ks))
    return labelled(evaluate(recs, targets, ks, metrics), split, "popularity")
