"""Diagnostics of splits, targets and recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import micros
from reckoner.operators.metrics import evaluate
from reckoner.operators.ordering import global_index, newest, scalar
from reckoner.operators.popularity import popularity_topk
from reckoner.operators.sequences import SEQ_ORDER


def pseudo_loo(interactions: DataFrame, min_items: int = 4, context_items: int = 9) -> tuple[DataFrame, DataFrame]:
    """Targets (newest row) and contexts (the rows before it) of users with enough rows.

    Contexts are long, with ``age`` 0 = newest context item. Only ``context_items + 1`` rows per user are kept,
    and that limit runs before the shuffle.
    """
    sizes = interactions.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_items)
    last = newest(interactions.select("user_id", *SEQ_ORDER), "user_id", SEQ_ORDER, context_items + 1)
    last = last.join(sizes.select("user_id"), "user_id", "left_semi")
    targets = last.where(F.col("age") == 0).select("user_id", "item_id")
    contexts = last.where(F.col("age") > 0).select("user_id", "item_id", (F.col("age") - 1).alias("age"))
    return targets, contexts


def shuffled_contexts(contexts: DataFrame) -> DataFrame:
    """Control: every user gets the context of the next user in id order, the last one that of the first."""
    users = global_index(contexts.select("user_id").distinct(), [F.col("user_id")], "_i")
    n = users.agg(F.count("*").alias("n"))
    donors = users.select(F.col("user_id").alias("_donor"), "_i")
    receivers = users.select("user_id", F.pmod(F.col("_i") + 1, scalar(n, "n")).alias("_i"))
    ring = receivers.join(donors, "_i").select("user_id", "_donor")
    return contexts.withColumnRenamed("user_id", "_donor").join(ring, "_donor").drop("_donor")


def _percent_flagged(rows: DataFrame, keys: DataFrame, on: list[str], name: str, present: bool) -> DataFrame:
    marked = keys.select(*on).distinct().withColumn("_m", F.lit(1))
    flag = F.col("_m").isNotNull() if present else F.col("_m").isNull()
    joined = rows.join(marked, on, "left")
    return joined.agg((F.try_divide(100.0 * F.count_if(flag), F.count("*"))).alias(name), F.count("*").alias("n_rows"))


def percent_cold(rows: DataFrame, train: DataFrame, name: str = "pct_cold") -> DataFrame:
    """Percent of rows (recommendations or targets) whose item never occurs in train."""
    return _percent_flagged(rows, train, ["item_id"], name, present=False)


def percent_already_seen(recs: DataFrame, train: DataFrame) -> DataFrame:
    return _percent_flagged(recs, train, ["user_id", "item_id"], "pct_seen", present=True)


def coverage(recs: DataFrame, top: int = 5) -> DataFrame:
    """Distinct items over all slots and the share of slots taken by the ``top`` items."""
    slots = recs.groupBy("item_id").agg(F.count("*").alias("slots"))
    head = slots.orderBy(F.col("slots").desc(), "item_id").limit(top).agg(F.sum("slots").alias("s"))
    return slots.agg(
        F.count("*").alias("distinct_items"),
        F.sum("slots").alias("n_slots"),
        (scalar(head, "s") / F.sum("slots")).alias("head_share"),
    )


def popularity_without_targets_seen(popular: DataFrame, targets: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Popularity control in which a target does not count as seen."""
    reduced = seen.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return popularity_topk(popular, targets.select("user_id").distinct(), reduced, k)


def train_items_per_warm_user(eval_rows: DataFrame, train: DataFrame) -> DataFrame:
    """Median train rows of the warm evaluation users per split."""
    n = train.groupBy("user_id").agg(F.count("*").alias("n"))
    users = eval_rows.select("split", "user_id").distinct().join(n, "user_id")
    return users.groupBy("split").agg(F.median("n").alias("median_train_rows"), F.count("*").alias("n_warm"))


def gap_days(eval_rows: DataFrame, train: DataFrame) -> DataFrame:
    """Median whole days between a user's last train row and first evaluation row, per split."""
    last = train.groupBy("user_id").agg(F.max("ts").alias("last_train"))
    first = eval_rows.groupBy("split", "user_id").agg(F.min("ts").alias("first_eval"))
    days = F.floor((micros(F.col("first_eval")) - micros(F.col("last_train"))) / F.lit(86_400_000_000))
    joined = first.join(last, "user_id").withColumn("days", days)
    return joined.groupBy("split").agg(F.median("days").alias("median_gap_days"), F.count("*").alias("n_users"))


def cold_shares(eval_rows: DataFrame, train: DataFrame) -> DataFrame:
    """Percent of evaluation rows with a cold item and percent of evaluation users that are cold, per split."""
    warm_items = train.select("item_id").distinct().withColumn("_item", F.lit(1))
    warm_users = train.select("user_id").distinct().withColumn("_user", F.lit(1))
    rows = eval_rows.join(warm_items, "item_id", "left").groupBy("split").agg(
        (100.0 * F.avg(F.col("_item").isNull().cast("int"))).alias("pct_cold_item_rows")
    )
    users = eval_rows.select("split", "user_id").distinct().join(warm_users, "user_id", "left").groupBy("split").agg(
        (100.0 * F.avg(F.col("_user").isNull().cast("int"))).alias("pct_cold_users")
    )
    return rows.join(users, "split")


def percent_in_head(targets: DataFrame, popular: DataFrame, head: int = 100) -> DataFrame:
    """Percent of evaluation targets among the ``head`` most popular train items, per split."""
    top = popular.where(F.col("rank") <= head).select("item_id").withColumn("_m", F.lit(1))
    joined = targets.join(top, "item_id", "left")
    return joined.groupBy("split").agg((100.0 * F.avg(F.col("_m").isNotNull().cast("int"))).alias("pct_in_head"))


def split_ranges(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
    )


def protocols_side_by_side(split: DataFrame, loo: DataFrame) -> DataFrame:
    """Per user: sizes of both protocols' contexts and targets, and whether the user is new to the time split."""
    by_time = split.groupBy("user_id").agg(
        *[F.count_if(F.col("split") == s).alias(f"time_{s}") for s in ("train", "val", "test")]
    )
    by_loo = loo.groupBy("user_id").agg(
        F.count_if(F.col("split") == "train").alias("loo_context"),
        F.max(F.when(F.col("split") == "test", F.col("item_id"))).alias("loo_target"),
    )
    return by_time.join(by_loo, "user_id", "left").withColumn("never_seen", (F.col("time_train") == 0).cast("int"))


def injection_report(labelled: DataFrame) -> DataFrame:
    """Positives, injected positives and their share in a labelled candidate table."""
    return labelled.agg(
        F.sum("label").alias("n_positive"),
        F.sum("injected").alias("n_injected"),
        F.try_divide(F.sum("injected"), F.sum("label")).alias("injected_share"),
    )


def retrieval_ceiling(recs: DataFrame, targets: DataFrame, k: int = 100) -> DataFrame:
    """Mean recall at the candidate depth: what a reranker can reach at most."""
    return evaluate(recs, targets, (k,), ("recall",))
