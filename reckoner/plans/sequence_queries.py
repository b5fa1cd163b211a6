"""Splits, sequences, targets and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import sequences, splitting
from reckoner.plans.registry import presented, query
from reckoner.sources.fixtures import Fixtures


def split_of(fx: Fixtures) -> DataFrame:
    """Labelled rows. The bounds and all uses read one staged table."""
    return splitting.time_split(fx.staged_interactions())


def train_in(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "train").drop("split")


def targets_in(split: DataFrame) -> DataFrame:
    """Distinct (split, user, item) of the held-out rows."""
    return split.where(F.col("split") != "train").select("split", "user_id", "item_id").distinct()


def train_of(fx: Fixtures) -> DataFrame:
    return train_in(split_of(fx))


@query("spl_01_time_split", "SELECT user_id, item_id, us, k1, k2, split FROM z_split")
def spl_01(fx: Fixtures) -> DataFrame:
    return presented(split_of(fx).select("user_id", "item_id", F.col("ts").alias("us"), "k1", "k2", "split"))


COLD_SQL = """SELECT count(DISTINCT {key}) FROM z_eval e WHERE e.split = s.split
    AND NOT EXISTS (SELECT 1 FROM z_train t WHERE t.{key} = e.{key})"""


@query(
    "spl_02_split_stats",
    f"""SELECT s.*, ({COLD_SQL.format(key='user_id')}) AS cold_users, ({COLD_SQL.format(key='item_id')}) AS cold_items
        FROM (SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
              min(us) AS first_us, max(us) AS last_us FROM z_split GROUP BY split) s""",
)
def spl_02(fx: Fixtures) -> DataFrame:
    return presented(splitting.split_stats(split_of(fx)))


@query(
    "spl_02_time_bounds",
    "SELECT lo, hi, round(val_start, 6) AS val_start, round(test_start, 6) AS test_start FROM z_bounds",
)
def spl_02_bounds(fx: Fixtures) -> DataFrame:
    return presented(splitting.time_bounds(fx.interactions()))


@query("spl_03_first_interactions", "SELECT user_id, item_id, us, k1, k2 FROM z_first")
def spl_03(fx: Fixtures) -> DataFrame:
    return presented(splitting.first_interactions(fx.interactions()).withColumnRenamed("ts", "us"))


@query("spl_04_loo_split", "SELECT user_id, item_id, us, split FROM z_loo")
def spl_04(fx: Fixtures) -> DataFrame:
    loo = splitting.loo_split(fx.interactions())
    return presented(loo.select("user_id", "item_id", F.col("ts").alias("us"), "split"))


@query(
    "spl_05_flatten_sequences",
    "SELECT user_id, item_id, us FROM z_loo WHERE split = 'train'",
)
def spl_05(fx: Fixtures) -> DataFrame:
    train = splitting.loo_split(fx.interactions()).where(F.col("split") == "train")
    seqs = sequences.chunked_lists(train, "user_id", sequences.SEQ_ORDER, {"item_ids": "item_id", "timestamps": "ts"})
    flat = seqs.select("user_id", F.inline(F.arrays_zip("item_ids", "timestamps")))
    return presented(flat.select("user_id", F.col("item_ids").alias("item_id"), F.col("timestamps").alias("us")))


@query(
    "spl_06_loo_stats",
    """WITH len AS (SELECT user_id, count_if(split = 'train') AS n FROM z_loo GROUP BY user_id),
       tr AS (SELECT DISTINCT item_id FROM z_loo WHERE split = 'train'),
       tv AS (SELECT DISTINCT item_id FROM z_loo WHERE split IN ('train', 'val'))
       SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS train_rows, round(median(n), 6) AS median_len,
              round(avg(n), 6) AS mean_len, round(quantile_cont(n, 0.95), 6) AS p95_len,
              (SELECT round(100.0 * avg(CASE WHEN item_id IN (SELECT item_id FROM tr) THEN 0.0 ELSE 1.0 END), 6) FROM z_loo WHERE split = 'val') AS pct_cold_val,
              (SELECT round(100.0 * avg(CASE WHEN item_id IN (SELECT item_id FROM tv) THEN 0.0 ELSE 1.0 END), 6) FROM z_loo WHERE split = 'test') AS pct_cold_test
       FROM len""",
)
def spl_06(fx: Fixtures) -> DataFrame:
    return presented(splitting.loo_stats(splitting.loo_split(fx.interactions())))


@query("spl_07_labelled_union", "SELECT split, user_id, item_id, us FROM z_split")
def spl_07(fx: Fixtures) -> DataFrame:
    split = split_of(fx)
    parts = [split.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    union = splitting.labelled_union(*parts)
    return presented(union.select("split", "user_id", "item_id", F.col("ts").alias("us")))


TRAIN_PARTS_SQL = f"""SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, k1, k2, item_id) - 1) // {sequences.LIST_ROWS} AS part
    FROM z_train"""
TARGET_PARTS_SQL = f"""SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1) // {sequences.LIST_ROWS} AS part
    FROM z_targets WHERE split = '{{split}}'"""


@query(
    "seq_01_user_sequences",
    f"""SELECT user_id, part, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY us, k1, k2, item_id) AS item_ids,
       string_agg(invoice_id, ' ' ORDER BY us, k1, k2, item_id) AS invoice_ids,
       string_agg(CAST(us AS VARCHAR), ' ' ORDER BY us, k1, k2, item_id) AS timestamps
       FROM ({TRAIN_PARTS_SQL}) GROUP BY user_id, part""",
)
def seq_01(fx: Fixtures) -> DataFrame:
    return presented(sequences.user_sequences(train_of(fx)))


@query(
    "seq_02_target_sets",
    f"""SELECT user_id, part, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS item_ids
       FROM ({TARGET_PARTS_SQL.format(split="test")}) GROUP BY user_id, part""",
)
def seq_02(fx: Fixtures) -> DataFrame:
    return presented(sequences.target_sets(split_of(fx).where(F.col("split") == "test")))


@query(
    "seq_03_length_stats",
    """SELECT count(*) AS n_users, round(median(n), 6) AS median_len, round(avg(n), 6) AS mean_len, max(n) AS max_len
       FROM (SELECT user_id, count(*) AS n FROM z_train GROUP BY user_id)""",
)
def seq_03(fx: Fixtures) -> DataFrame:
    return presented(sequences.length_stats(train_of(fx)))


@query(
    "seq_04_padded_tails",
    """SELECT user_id, array_to_string(list_concat(a, list_transform(range(20 - len(a)), lambda i: -1)), ' ') AS items,
       CAST(len(a) AS BIGINT) AS length FROM (SELECT user_id, list(item_id ORDER BY us, k1, k2, item_id) AS a
         FROM (SELECT * FROM z_train QUALIFY row_number() OVER (PARTITION BY user_id
               ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) <= 20) GROUP BY user_id)""",
)
def seq_04(fx: Fixtures) -> DataFrame:
    return presented(sequences.padded_tails(train_of(fx), 20, -1))


@query(
    "seq_05_user_profiles",
    """SELECT user_id, i AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY user_id)), 6) AS value FROM (
         SELECT user_id, i, avg(x) AS m FROM (
           SELECT t.user_id, unnest(range(1, 65)) AS i, unnest(e.v) AS x FROM z_train t JOIN z_emb e USING (item_id))
         GROUP BY user_id, i)""",
)
def seq_05(fx: Fixtures) -> DataFrame:
    profiles = sequences.user_profiles(train_of(fx), fx.item_embeddings())
    long = profiles.select("user_id", F.posexplode("profile").alias("dim", "value"))
    return presented(long.withColumn("dim", F.col("dim") + 1))


@query("seq_06_history_counts", "SELECT user_id, count(*) AS n FROM z_train GROUP BY user_id")
def seq_06(fx: Fixtures) -> DataFrame:
    return presented(sequences.history_counts(train_of(fx)))


@query(
    "seq_07_activity_distribution",
    """SELECT count(*) AS n_users, round(median(n), 6) AS median_n, round(avg(n), 6) AS mean_n, max(n) AS max_n
       FROM (SELECT user_id, count(*) AS n FROM z_inter GROUP BY user_id)""",
)
def seq_07(fx: Fixtures) -> DataFrame:
    return presented(sequences.activity_distribution(fx.interactions()))


@query(
    "seq_07_activity_histogram",
    """SELECT least(n, 40) AS n_interactions, count(*) AS n_users
       FROM (SELECT user_id, count(*) AS n FROM z_inter GROUP BY user_id) GROUP BY ALL""",
)
def seq_07_histogram(fx: Fixtures) -> DataFrame:
    return presented(sequences.activity_histogram(fx.interactions()))


@query(
    "seq_08_history_listing",
    """SELECT s.user_id, s.item_id, s.split, s.us, strftime(make_timestamp(s.us), '%Y-%m-%d') AS day,
       substring(c.description, 1, 80) AS title FROM z_split s JOIN z_catalog c USING (item_id)""",
)
def seq_08(fx: Fixtures) -> DataFrame:
    return presented(sequences.history_listing(split_of(fx), fx.catalog()))


@query(
    "seq_09_concentration",
    """SELECT CAST(sum(n) AS BIGINT) AS n_rows, round(CAST(sum(CASE WHEN i < 10 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS head_share,
       round(CAST(sum(CASE WHEN i >= c - c // 2 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS bottom_half_share
       FROM (SELECT n, row_number() OVER (ORDER BY n DESC, item_id) - 1 AS i, count(*) OVER () AS c
             FROM (SELECT item_id, count(*) AS n FROM z_inter GROUP BY item_id))""",
)
def seq_09(fx: Fixtures) -> DataFrame:
    return presented(sequences.popularity_concentration(fx.interactions()))


@query(
    "seq_10_nth_most_active",
    "SELECT user_id, count(*) AS n FROM z_inter GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1 OFFSET 4",
)
def seq_10(fx: Fixtures) -> DataFrame:
    return presented(sequences.nth_most_active(fx.interactions(), 5))
