"""Popularity retrieval, fallback, seen filters and list presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import compose, popularity as pop
from reckoner.operators.ordering import durable
from reckoner.plans.registry import presented, query
from reckoner.plans.sequence_queries import split_of, targets_in, train_in, train_of
from reckoner.sources.fixtures import Fixtures

K = 20


def targets_of(fx: Fixtures) -> DataFrame:
    return targets_in(split_of(fx))


def popularity_recs(fx: Fixtures, k: int = K, split: DataFrame | None = None) -> DataFrame:
    """Unseen popularity lists of all users with held-out rows."""
    split = split_of(fx) if split is None else split
    train = train_in(split)
    users = targets_in(split).select("user_id").distinct()
    return pop.popularity_topk(pop.popularity(train), users, pop.seen_pairs(train), k)


@query("ret_01_popularity", "SELECT item_id, n, rank FROM z_pop")
def ret_01(fx: Fixtures) -> DataFrame:
    return presented(pop.popularity(train_of(fx)))


@query("ret_02_seen_pairs", "SELECT user_id, item_id FROM z_seen")
def ret_02(fx: Fixtures) -> DataFrame:
    return pop.seen_pairs(train_of(fx))


@query("ret_03_popularity_topk", "SELECT user_id, item_id, score, rank FROM z_pop_recs")
def ret_03(fx: Fixtures) -> DataFrame:
    return presented(popularity_recs(fx))


@query("ret_04_als_counts", "SELECT user_id, item_id, count(*) AS n FROM z_train GROUP BY user_id, item_id")
def ret_04_counts(fx: Fixtures) -> DataFrame:
    from reckoner.operators.factors import interaction_counts

    return presented(interaction_counts(train_of(fx)))


@query(
    "ret_05_cold_users",
    "SELECT user_id FROM z_eval_users WHERE user_id NOT IN (SELECT user_id FROM z_train)",
)
def ret_05(fx: Fixtures) -> DataFrame:
    return pop.cold_users(targets_of(fx), train_of(fx))


def _warm_lists(fx: Fixtures, recs: DataFrame) -> DataFrame:
    """Lists for warm users only: popularity without the seen items, as a stand-in for any warm-only tier."""
    train = train_of(fx)
    return recs.join(train.select("user_id").distinct(), "user_id", "left_semi")


@query(
    "ret_08_fallback",
    """SELECT user_id, item_id, score, rank FROM z_pop_recs WHERE user_id IN (SELECT user_id FROM z_train)
       UNION ALL SELECT u.user_id, p.item_id, CAST(p.n AS DOUBLE), p.rank FROM z_eval_users u CROSS JOIN z_pop p
       WHERE p.rank <= 20 AND u.user_id NOT IN (SELECT user_id FROM z_train)""",
)
def ret_08(fx: Fixtures) -> DataFrame:
    recs = durable(popularity_recs(fx))
    return presented(compose.with_fallback(_warm_lists(fx, recs), recs))


@query(
    "ret_09_drop_seen",
    """SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
       FROM z_pop_recs r WHERE NOT EXISTS (SELECT 1 FROM z_targets t
            WHERE t.split = 'val' AND t.user_id = r.user_id AND t.item_id = r.item_id)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 10""",
)
def ret_09(fx: Fixtures) -> DataFrame:
    context = targets_of(fx).where(F.col("split") == "val")
    return presented(compose.drop_seen(popularity_recs(fx), context, 10).select("user_id", "item_id", "score", "rank"))


@query(
    "ret_17_log_softmax",
    """SELECT user_id, item_id, round(l - (max(l) OVER w + ln(sum(exp(l - m)) OVER w)), 6) AS log_prob FROM (
         SELECT user_id, item_id, ln(score) AS l, max(ln(score)) OVER (PARTITION BY user_id) AS m FROM z_pop_recs)
       WINDOW w AS (PARTITION BY user_id)""",
)
def ret_17(fx: Fixtures) -> DataFrame:
    recs = popularity_recs(fx).withColumn("logit", F.ln("score"))
    return presented(compose.log_softmax(recs, "logit").select("user_id", "item_id", "log_prob"))


SIDE_BY_SIDE_SQL = """SELECT m.model, m.user_id, m.item_id, m.rank,
    CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit, c.description FROM (
      SELECT 'popularity' AS model, user_id, item_id, rank FROM z_pop_recs
      UNION ALL SELECT 'popularity, unfiltered', u.user_id, p.item_id, p.rank FROM z_eval_users u CROSS JOIN z_pop p WHERE p.rank <= 20) m
    LEFT JOIN z_targets t ON t.split = 'test' AND t.user_id = m.user_id AND t.item_id = m.item_id
    LEFT JOIN z_catalog c ON c.item_id = m.item_id"""


def _side_by_side(fx: Fixtures) -> DataFrame:
    train, targets = train_of(fx), targets_of(fx)
    nobody = train.select("user_id", "item_id").where(F.lit(False))
    plain = pop.popularity_topk(pop.popularity(train), targets.select("user_id").distinct(), nobody, K)
    tiers = {"popularity": popularity_recs(fx), "popularity, unfiltered": plain}
    return compose.side_by_side(tiers, targets.where(F.col("split") == "test"), fx.catalog())


@query("ret_18_side_by_side", SIDE_BY_SIDE_SQL.replace("THEN 0 ELSE 1", "THEN 0::BIGINT ELSE 1::BIGINT"))
def ret_18(fx: Fixtures) -> DataFrame:
    return presented(_side_by_side(fx))


@query(
    "ret_18_hit_ranks",
    f"""SELECT user_id, model, min(CASE WHEN hit = 1 THEN rank END) AS hit_rank, count(*) AS n_recs
        FROM ({SIDE_BY_SIDE_SQL}) GROUP BY user_id, model""",
)
def ret_18_hits(fx: Fixtures) -> DataFrame:
    return presented(compose.hit_ranks(_side_by_side(fx)))


@query(
    "ret_19_titles",
    "SELECT r.user_id, r.rank, r.item_id, c.description FROM z_pop_recs r LEFT JOIN z_catalog c USING (item_id)",
)
def ret_19(fx: Fixtures) -> DataFrame:
    return presented(compose.with_titles(popularity_recs(fx), fx.catalog()).select("user_id", "rank", "item_id", "description"))
