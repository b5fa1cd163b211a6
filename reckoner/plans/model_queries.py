"""Learned and counted retrieval models: ALS, dot-product scorer, transitions, token model, beam search."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import compose, dotscore, factors, popularity as pop, token_model as tm, transitions as tr
from reckoner.operators.evaluation import sample_users
from reckoner.operators.ordering import durable
from reckoner.plans.content_queries import LEVELS, tokens_of
from reckoner.plans.ctes import BEAM
from reckoner.plans.registry import presented, query
from reckoner.plans.retrieval_queries import popularity_recs, targets_of
from reckoner.plans.sequence_queries import split_of, train_in, train_of
from reckoner.sources.fixtures import Fixtures


@lru_cache(maxsize=4)
def _fitted(application: str, folder: str):
    from pyspark.sql import SparkSession

    return factors.fit_als(train_of(Fixtures(SparkSession.active(), folder)))


def als_of(fx: Fixtures):
    """One fitted model per session and folder, shared by the queries that only read its factors."""
    return _fitted(fx.spark.sparkContext.applicationId, fx.folder)


@query("ret_04_als_fit")
def ret_04(fx: Fixtures) -> DataFrame:
    model = als_of(fx)
    users = factors.user_factors(model).select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "vector")
    items = factors.item_factors(model).select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "vector")
    return presented(users.unionByName(items))


@query("ret_06_als_topk")
def ret_06(fx: Fixtures) -> DataFrame:
    train = train_of(fx)
    users = targets_of(fx).select("user_id").distinct()
    return presented(factors.als_topk(als_of(fx), users, pop.seen_pairs(train), 20))


@query("ret_07_als_candidates")
def ret_07(fx: Fixtures) -> DataFrame:
    train = train_of(fx)
    users = sample_users(targets_of(fx).where(F.col("split") == "val"), 1000, 42)
    return presented(factors.als_topk(als_of(fx), users, pop.seen_pairs(train), 100))


@query("emb_08_factor_neighbours")
def emb_08(fx: Fixtures) -> DataFrame:
    items = factors.item_factors(als_of(fx)).withColumnRenamed("vector", "embedding")
    return presented(dotscore.cosine_topk(items, items, 10))


STATE_SQL = """SELECT user_id, i, sum(w * x) / sum(w) AS s FROM (
      SELECT t.user_id, pow(0.8::DOUBLE, t.rn - 1) AS w, unnest(range(64)) AS i, unnest(e.v) AS x FROM (
        SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) AS rn
        FROM z_train QUALIFY rn <= 20) t JOIN z_emb e USING (item_id)) GROUP BY user_id, i"""


@query("ret_11_history_state", f"SELECT user_id, i AS dim, round(s, 6) AS value FROM ({STATE_SQL})")
def ret_11(fx: Fixtures) -> DataFrame:
    vectors = fx.item_embeddings().withColumnRenamed("embedding", "vector")
    states = dotscore.history_state(train_of(fx), vectors)
    return presented(states.select("user_id", F.posexplode("vector").alias("dim", "value")))


@query(
    "ret_10_dot_topk",
    f"""SELECT user_id, item_id, score + 0.0 AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
          SELECT u.user_id, e.item_id, round(list_dot_product(u.v, e.v), 6) AS score
          FROM (SELECT user_id, list(s ORDER BY i) AS v FROM ({STATE_SQL}) GROUP BY user_id) u CROSS JOIN z_emb e)
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM z_seen) QUALIFY rank <= 10""",
)
def ret_10(fx: Fixtures) -> DataFrame:
    train = durable(train_of(fx))
    vectors = fx.item_embeddings().withColumnRenamed("embedding", "vector")
    states = durable(dotscore.history_state(train, vectors))
    return presented(dotscore.score_dot_topk(states, vectors, pop.seen_pairs(train), 10))


TRANSITIONS_SQL = """SELECT a AS item_id, b AS next_item, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY a) AS probability
    FROM (SELECT a, b, count(*) AS n FROM z_pairs WHERE b IS NOT NULL GROUP BY a, b)"""


@query(
    "ret_12_transitions",
    f"SELECT item_id, next_item, n, round(probability, 6) AS probability FROM ({TRANSITIONS_SQL})",
)
def ret_12(fx: Fixtures) -> DataFrame:
    return presented(tr.fit_transitions(train_of(fx)))


@query(
    "ret_12_transition_topk",
    f"""WITH w AS (SELECT user_id, item_id, sum(pow(0.8::DOUBLE, rn - 1)) AS w FROM (SELECT user_id, item_id, row_number() OVER (
           PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) AS rn FROM z_train QUALIFY rn <= 5) GROUP BY user_id, item_id),
       s AS (SELECT w.user_id, t.next_item AS item_id, CAST(CAST(sum(w.w * t.probability) AS FLOAT) AS DOUBLE) AS score
             FROM w JOIN ({TRANSITIONS_SQL}) t USING (item_id) GROUP BY w.user_id, t.next_item),
       own AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s
         WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM z_seen) QUALIFY rank <= 20),
       tiers AS (SELECT user_id, item_id, score, rank, 0 AS tier FROM own UNION ALL SELECT user_id, item_id, score, rank, 1 FROM z_pop_recs),
       firsts AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY tier, rank) = 1)
       SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY tier, rank) AS rank FROM firsts
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, rank) <= 20""",
)
def ret_12_topk(fx: Fixtures) -> DataFrame:
    split = split_of(fx)
    train = train_in(split)
    popular = popularity_recs(fx, 20, split)
    recs = tr.transition_topk(train, tr.fit_transitions(train), pop.seen_pairs(train), popular, 20)
    return presented(recs)


def model_of(fx: Fixtures, train: DataFrame | None = None) -> tuple[tm.TokenModel, DataFrame]:
    tokens, _ = tokens_of(fx)
    tokens = durable(tokens)
    return tm.fit_token_model(train_of(fx) if train is None else train, tokens, LEVELS + 1), tokens


@query(
    "ret_13_token_model",
    """SELECT depth::BIGINT AS depth, x, array_to_string(prefix, '-') AS prefix, token, round(p, 6) AS probability FROM z_prob
       WHERE (depth, x, prefix, token) IN (SELECT depth, x, prefix, token FROM z_observed)""",
)
def ret_13(fx: Fixtures) -> DataFrame:
    model, _ = model_of(fx)
    keys = ["depth", "prefix", "token"]
    seen = model.observed.join(model.totals, ["depth", "x", "prefix"]).join(model.children.select(*keys, "q"), keys)
    return presented(seen.select("depth", "x", "prefix", "token", model.probability().alias("probability")))


@query(
    "ret_13_backoff",
    "SELECT depth::BIGINT AS depth, array_to_string(prefix, '-') AS prefix, token, round(q, 6) AS q FROM z_q",
)
def ret_13_backoff(fx: Fixtures) -> DataFrame:
    return presented(model_of(fx)[0].children.select("depth", "prefix", "token", "q"))


@query(
    "ret_14_beam_search",
    f"SELECT x AS list_id, rank, item_id, round(logp, 6) AS score FROM z_beam_lists WHERE rank <= {BEAM}",
)
def ret_14(fx: Fixtures) -> DataFrame:
    model, tokens = model_of(fx)
    contexts = tokens.select(F.col("tok1").alias("x")).distinct()
    return presented(tm.beam_search(contexts, model, BEAM))


@query("ret_15_beam_unseen", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM z_beam_recs")
def ret_15(fx: Fixtures) -> DataFrame:
    train = durable(train_of(fx))
    model, tokens = model_of(fx, train)
    return presented(tm.beam_topk(tm.user_contexts(train, tokens), model, pop.seen_pairs(train), BEAM, BEAM))


@query(
    "ret_15_short_lists",
    f"""SELECT user_id, n_recs FROM (SELECT user_id, count(item_id) AS n_recs FROM z_eval_users LEFT JOIN z_beam_recs USING (user_id) GROUP BY user_id)
       WHERE n_recs < {BEAM}""",
)
def ret_15_short(fx: Fixtures) -> DataFrame:
    train = durable(train_of(fx))
    model, tokens = model_of(fx, train)
    recs = tm.beam_topk(tm.user_contexts(train, tokens), model, pop.seen_pairs(train), BEAM, BEAM)
    return presented(compose.short_lists(recs, targets_of(fx).select("user_id").distinct(), BEAM))


@query(
    "ret_16_top_families",
    """SELECT x, rank, token, round(p, 6) AS probability, n_items FROM (
         SELECT x, token, round(p, 9) AS p, row_number() OVER (PARTITION BY x ORDER BY round(p, 9) DESC, token) AS rank FROM z_prob WHERE depth = 0)
       JOIN (SELECT tok1 AS token, count(*) AS n_items FROM z_tok GROUP BY tok1) USING (token) WHERE rank <= 3""",
)
def ret_16(fx: Fixtures) -> DataFrame:
    model, tokens = model_of(fx)
    contexts = tokens.select(F.col("tok1").alias("x")).distinct()
    return presented(tm.top_families(model, contexts, tokens))
