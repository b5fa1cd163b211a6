"""Per-user sequences, target sets and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import micros, pad_right
from reckoner.functions.vectors import unit
from reckoner.operators.dotscore import weighted_means
from reckoner.operators.ordering import global_index, newest, positions

SEQ_ORDER = ["ts", "k1", "k2", "item_id"]

# Elements of one list row: element n of a key stands in the row with ``part`` n div LIST_ROWS.
LIST_ROWS = 10_000


def chunked_lists(df: DataFrame, key: str, order_by: list[str], fields: dict[str, str], limit: int = LIST_ROWS) -> DataFrame:
    """Ordered lists per key in rows of at most ``limit`` elements: ``key``, ``part`` (position div ``limit``) and the lists.

    All rows are numbered over range partitions of (key, order), so a key of any size stays spread over many tasks, and no
    list grows without bound. ``fields`` maps output columns to input columns.
    """
    df = df.select(key, *dict.fromkeys([*order_by, *fields.values()]))
    part = F.floor(F.col("_pos") / limit).cast("long")
    parts = positions(df, [key], order_by, "_pos").withColumn("part", part)
    carried = dict.fromkeys([*order_by, *fields.values()])
    rows = F.array_sort(F.collect_list(F.struct(*carried)))
    lists = parts.groupBy(key, "part").agg(rows.alias("_rows"))
    return lists.select(key, "part", *[F.col(f"_rows.{src}").alias(out) for out, src in fields.items()])


def user_sequences(interactions: DataFrame, limit: int = LIST_ROWS) -> DataFrame:
    """Chronological item, invoice and time lists per user."""
    fields = {"item_ids": "item_id", "invoice_ids": "invoice_id", "timestamps": "ts"}
    return chunked_lists(interactions, "user_id", SEQ_ORDER, fields, limit)


def target_sets(interactions: DataFrame, limit: int = LIST_ROWS) -> DataFrame:
    """Sorted distinct items per user."""
    pairs = interactions.select("user_id", "item_id").distinct()
    return chunked_lists(pairs, "user_id", ["item_id"], {"item_ids": "item_id"}, limit)


def target_pairs(interactions: DataFrame) -> DataFrame:
    """Long form of the target sets."""
    return interactions.select("user_id", "item_id").distinct()


def length_stats(interactions: DataFrame) -> DataFrame:
    """Median, mean and maximum history length; the median's state is the set of distinct lengths."""
    lengths = history_counts(interactions)
    return lengths.agg(
        F.count("*").alias("n_users"),
        F.median("n").alias("median_len"),
        F.avg("n").alias("mean_len"),
        F.max("n").alias("max_len"),
    )


def padded_tails(interactions: DataFrame, n_items: int, pad) -> DataFrame:
    """Most recent ``n_items`` per user, right-padded with ``pad``, and the true length."""
    last = newest(interactions.select("user_id", *SEQ_ORDER), "user_id", SEQ_ORDER, n_items)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("o"), "item_id")))
    tails = last.groupBy("user_id").agg(ordered.alias("_rows")).select("user_id", F.col("_rows.item_id").alias("_tail"))
    return tails.select(
        "user_id", pad_right(F.col("_tail"), n_items, pad).alias("items"), F.size("_tail").alias("length")
    )


def user_profiles(history: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Unit-length mean of the history's item vectors; repeats count, a zero mean stays zero.

    Rows meet chunks of the item vectors; no vector is moved per row.
    """
    rows = history.select(F.col("user_id").alias("id"), F.col("item_id").alias("other"), F.lit(1.0).alias("weight"))
    means = weighted_means(rows, embeddings.select(F.col("item_id").alias("id"), F.col("embedding").alias("vector")))
    return means.select(F.col("id").alias("user_id"), unit(F.col("vector")).alias("profile"))


def history_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count("*").alias("n"))


def activity_distribution(interactions: DataFrame) -> DataFrame:
    n = history_counts(interactions)
    return n.agg(
        F.count("*").alias("n_users"), F.median("n").alias("median_n"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n")
    )


def activity_histogram(interactions: DataFrame, clip: int = 40) -> DataFrame:
    n = history_counts(interactions)
    return n.groupBy(F.least(F.col("n"), F.lit(clip)).alias("n_interactions")).agg(F.count("*").alias("n_users"))


def history_listing(split: DataFrame, catalog: DataFrame, users: DataFrame | None = None, width: int = 80) -> DataFrame:
    """Split label, date and shortened title of every row of the given users (all by default); null without a title."""
    rows = split if users is None else split.join(users.select("user_id"), "user_id", "left_semi")
    return rows.join(catalog.select("item_id", "description"), "item_id", "left").select(
        "user_id",
        "item_id",
        "split",
        micros(F.col("ts")).alias("us"),
        F.to_date("ts").alias("day"),
        F.substring("description", 1, width).alias("title"),
    )


def popularity_concentration(interactions: DataFrame, head: int = 10) -> DataFrame:
    """Share of rows on the ``head`` most popular items and on the less popular half of the items."""
    counts = interactions.groupBy("item_id").agg(F.count("*").alias("n"))
    ranked = global_index(counts, [F.col("n").desc(), F.col("item_id")], "i")
    n_items = counts.agg(F.count("*").alias("c"))
    cut = n_items.select((F.col("c") - F.floor(F.col("c") / 2)).alias("c"))
    return ranked.agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.when(F.col("i") < head, F.col("n")).otherwise(0)) / F.sum("n")).alias("head_share"),
        (F.sum(F.when(F.col("i") >= cut.scalar(), F.col("n")).otherwise(0)) / F.sum("n")).alias("bottom_half_share"),
    )


def nth_most_active(interactions: DataFrame, n: int) -> DataFrame:
    """The user in place ``n`` by interaction count."""
    top = history_counts(interactions).orderBy(F.col("n").desc(), "user_id").limit(n)
    return top.orderBy(F.col("n"), F.col("user_id").desc()).limit(1)
