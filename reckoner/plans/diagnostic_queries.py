"""Diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import diagnostics as dia, popularity as pop, splitting, token_model as tm
from reckoner.operators.ordering import durable
from reckoner.plans.ctes import BEAM, metrics_sql
from reckoner.plans.model_queries import model_of
from reckoner.plans.registry import presented, query
from reckoner.plans.retrieval_queries import popularity_recs, targets_of
from reckoner.plans.sequence_queries import split_of, train_of
from reckoner.sources.fixtures import Fixtures

NEWEST_TRAIN = """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) AS rn,
    count(*) OVER (PARTITION BY user_id) AS n FROM z_train"""
CONTEXT_SQL = f"SELECT user_id, item_id, rn - 2 AS age FROM ({NEWEST_TRAIN}) WHERE n >= 4 AND rn BETWEEN 2 AND 10"


def _eval_rows(fx: Fixtures) -> DataFrame:
    return split_of(fx).where(F.col("split") != "train")


@query("dia_01_pseudo_loo_targets", f"SELECT user_id, item_id FROM ({NEWEST_TRAIN}) WHERE n >= 4 AND rn = 1")
def dia_01(fx: Fixtures) -> DataFrame:
    return dia.pseudo_loo(train_of(fx))[0]


@query("dia_01_pseudo_loo_contexts", CONTEXT_SQL)
def dia_01_contexts(fx: Fixtures) -> DataFrame:
    return presented(dia.pseudo_loo(train_of(fx))[1])


@query(
    "dia_02_shuffled_contexts",
    f"""SELECT u.user_id, c.item_id, c.age FROM (
          SELECT user_id, coalesce(lead(user_id) OVER (ORDER BY user_id), min(user_id) OVER ()) AS donor
          FROM (SELECT DISTINCT user_id FROM ({CONTEXT_SQL}))) u JOIN ({CONTEXT_SQL}) c ON c.user_id = u.donor""",
)
def dia_02(fx: Fixtures) -> DataFrame:
    return presented(dia.shuffled_contexts(dia.pseudo_loo(train_of(fx))[1]))


@query(
    "dia_03_cold_recommendations",
    """SELECT round(100.0 * count_if(item_id NOT IN (SELECT item_id FROM z_loo_train)) / count(*), 6) AS pct_cold, count(*) AS n_rows
       FROM z_pop_recs""",
)
def dia_03(fx: Fixtures) -> DataFrame:
    loo = splitting.loo_split(fx.staged_interactions())
    return presented(dia.percent_cold(popularity_recs(fx), loo.where(F.col("split") == "train")))


@query(
    "dia_04_already_seen",
    """SELECT round(100.0 * count_if(s.item_id IS NOT NULL) / count(*), 6) AS pct_seen, count(*) AS n_rows
       FROM z_pop_recs r LEFT JOIN z_loo_train s USING (user_id, item_id)""",
)
def dia_04(fx: Fixtures) -> DataFrame:
    loo = splitting.loo_split(fx.staged_interactions())
    return presented(dia.percent_already_seen(popularity_recs(fx), loo.where(F.col("split") == "train")))


def raw_beam_recs(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Generated lists of all users with a context, seen items not removed, and the train rows they come from."""
    train = durable(train_of(fx))
    model, tokens = model_of(fx, train)
    nobody = pop.seen_pairs(train).where("false")
    return tm.beam_topk(tm.user_contexts(train, tokens), model, nobody, BEAM, BEAM), train


RAW_BEAM_SQL = f"SELECT user_id, item_id FROM z_user_x JOIN z_beam_lists USING (x) WHERE rank <= {BEAM}"


@query(
    "dia_03_cold_generated",
    f"""SELECT round(100.0 * count_if(item_id NOT IN (SELECT item_id FROM z_train)) / count(*), 6) AS pct_cold, count(*) AS n_rows
       FROM ({RAW_BEAM_SQL})""",
)
def dia_03_generated(fx: Fixtures) -> DataFrame:
    recs, train = raw_beam_recs(fx)
    return presented(dia.percent_cold(recs, train))


@query(
    "dia_04_seen_generated",
    f"""SELECT round(100.0 * count_if(s.item_id IS NOT NULL) / count(*), 6) AS pct_seen, count(*) AS n_rows
       FROM ({RAW_BEAM_SQL}) r LEFT JOIN z_seen s USING (user_id, item_id)""",
)
def dia_04_generated(fx: Fixtures) -> DataFrame:
    recs, train = raw_beam_recs(fx)
    return presented(dia.percent_already_seen(recs, train))


@query(
    "dia_05_coverage",
    """SELECT count(*) AS distinct_items, CAST(sum(slots) AS BIGINT) AS n_slots,
       round(CAST(sum(CASE WHEN r <= 5 THEN slots ELSE 0 END) AS DOUBLE) / sum(slots), 6) AS head_share
       FROM (SELECT slots, row_number() OVER (ORDER BY slots DESC, item_id) AS r
             FROM (SELECT item_id, count(*) AS slots FROM z_pop_recs GROUP BY item_id))""",
)
def dia_05(fx: Fixtures) -> DataFrame:
    return presented(dia.coverage(popularity_recs(fx)))


@query(
    "dia_06_cold_targets",
    """SELECT round(100.0 * count_if(item_id NOT IN (SELECT item_id FROM z_train)) / count(*), 6) AS pct_cold, count(*) AS n_rows
       FROM z_targets WHERE split = 'val'""",
)
def dia_06(fx: Fixtures) -> DataFrame:
    return presented(dia.percent_cold(targets_of(fx).where(F.col("split") == "val"), train_of(fx)))


@query(
    "dia_07_popularity_control",
    """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
       FROM (SELECT DISTINCT user_id FROM z_targets WHERE split = 'val') u CROSS JOIN z_pop p
       WHERE NOT EXISTS (SELECT 1 FROM z_seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id
                         AND NOT EXISTS (SELECT 1 FROM z_targets t WHERE t.split = 'val' AND t.user_id = s.user_id AND t.item_id = s.item_id))
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 20""",
)
def dia_07(fx: Fixtures) -> DataFrame:
    train = train_of(fx)
    targets = targets_of(fx).where(F.col("split") == "val")
    recs = dia.popularity_without_targets_seen(pop.popularity(train), targets, pop.seen_pairs(train), 20)
    return presented(recs.select("user_id", "item_id", "rank"))


@query(
    "dia_08_train_items_per_warm_user",
    """SELECT e.split, round(median(n), 6) AS median_train_rows, count(*) AS n_warm FROM (SELECT DISTINCT split, user_id FROM z_eval) e
       JOIN (SELECT user_id, count(*) AS n FROM z_train GROUP BY user_id) t USING (user_id) GROUP BY e.split""",
)
def dia_08(fx: Fixtures) -> DataFrame:
    return presented(dia.train_items_per_warm_user(_eval_rows(fx), train_of(fx)))


@query(
    "dia_09_gap_days",
    """SELECT split, round(median(CAST(floor((f - l) / 86400000000.0) AS BIGINT)), 6) AS median_gap_days, count(*) AS n_users
       FROM (SELECT split, user_id, min(us) AS f FROM z_eval GROUP BY split, user_id)
       JOIN (SELECT user_id, max(us) AS l FROM z_train GROUP BY user_id) USING (user_id) GROUP BY split""",
)
def dia_09(fx: Fixtures) -> DataFrame:
    return presented(dia.gap_days(_eval_rows(fx), train_of(fx)))


@query(
    "dia_10_cold_shares",
    """SELECT split, round(100.0 * count_if(item_id NOT IN (SELECT item_id FROM z_train)) / count(*), 6) AS pct_cold_item_rows,
       round(100.0 * count(DISTINCT CASE WHEN user_id NOT IN (SELECT user_id FROM z_train) THEN user_id END) / count(DISTINCT user_id), 6)
       AS pct_cold_users FROM z_eval GROUP BY split""",
)
def dia_10(fx: Fixtures) -> DataFrame:
    return presented(dia.cold_shares(_eval_rows(fx), train_of(fx)))


@query(
    "dia_11_targets_in_head",
    """SELECT split, round(100.0 * count_if(item_id IN (SELECT item_id FROM z_pop WHERE rank <= 100)) / count(*), 6) AS pct_in_head
       FROM z_targets GROUP BY split""",
)
def dia_11(fx: Fixtures) -> DataFrame:
    return presented(dia.percent_in_head(targets_of(fx), pop.popularity(train_of(fx))))


@query(
    "dia_12_split_ranges",
    """SELECT split, strftime(make_timestamp(min(us)), '%Y-%m-%d') AS first_day, strftime(make_timestamp(max(us)), '%Y-%m-%d') AS last_day,
       count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM z_split GROUP BY split""",
)
def dia_12(fx: Fixtures) -> DataFrame:
    return presented(dia.split_ranges(split_of(fx)))


@query(
    "dia_13_protocols",
    """SELECT t.*, l.loo_context, l.loo_target, CASE WHEN t.time_train = 0 THEN 1 ELSE 0 END::BIGINT AS never_seen FROM (
         SELECT user_id, count_if(split = 'train') AS time_train, count_if(split = 'val') AS time_val,
                count_if(split = 'test') AS time_test FROM z_split GROUP BY user_id) t
       LEFT JOIN (SELECT user_id, count_if(split = 'train') AS loo_context, max(CASE WHEN split = 'test' THEN item_id END) AS loo_target
                  FROM z_loo GROUP BY user_id) l USING (user_id)""",
)
def dia_13(fx: Fixtures) -> DataFrame:
    return presented(dia.protocols_side_by_side(split_of(fx), splitting.loo_split(fx.interactions())))


@query(
    "dia_14_retrieval_ceiling",
    metrics_sql(
        "SELECT user_id, item_id, rank FROM z_cands", "SELECT user_id, item_id FROM z_targets WHERE split = 'val'", (100,), ("recall",)
    ),
)
def dia_14(fx: Fixtures) -> DataFrame:
    recs = popularity_recs(fx, 100)
    return presented(dia.retrieval_ceiling(recs, targets_of(fx).where(F.col("split") == "val")))
