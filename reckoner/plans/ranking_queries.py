"""Candidate features, labels, rerankers and full evaluation runs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import (
    compose,
    diagnostics as dia,
    dotscore,
    evaluation,
    factors,
    features as feat,
    labels as lab,
    metrics,
    popularity as pop,
    reranker as rr,
    sequences,
    splitting,
    token_model as tm,
    transitions as tr,
)
from reckoner.operators.ordering import durable, scratch_path
from reckoner.plans.content_queries import LEVELS, fitted_tokens_of
from reckoner.plans.model_queries import als_of
from reckoner.plans.registry import presented, query
from reckoner.plans.retrieval_queries import targets_of
from reckoner.plans.sequence_queries import split_of, targets_in, train_in, train_of
from reckoner.sources import writers
from reckoner.sources.fixtures import Fixtures


def val_targets(fx: Fixtures) -> DataFrame:
    return targets_of(fx).where(F.col("split") == "val").select("user_id", "item_id")


def candidates_of(fx: Fixtures, split: DataFrame | None = None) -> DataFrame:
    """Popularity top 100 of the validation users with score 1 / rank."""
    split = split_of(fx) if split is None else split
    train = train_in(split)
    users = targets_in(split).where(F.col("split") == "val").select("user_id").distinct()
    recs = pop.popularity_topk(pop.popularity(train), users, pop.seen_pairs(train), 100)
    return recs.withColumn("score", F.lit(1.0) / F.col("rank"))


def features_of(fx: Fixtures) -> DataFrame:
    split = split_of(fx)
    return feat.candidate_features(durable(candidates_of(fx, split)), train_in(split), fx.catalog(), fx.item_embeddings())


def als_features_of(fx: Fixtures) -> DataFrame:
    """Features of the ALS top 100 of the validation users, with ALS scores: what the rerankers are fitted on and serve."""
    split = split_of(fx)
    train = durable(train_in(split))
    users = targets_in(split).where(F.col("split") == "val").select("user_id").distinct()
    recs = durable(factors.als_topk(als_of(fx), users, pop.seen_pairs(train), 100))
    return feat.candidate_features(recs, train, fx.catalog(), fx.item_embeddings())


@lru_cache(maxsize=4)
def _als_features(application: str, folder: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return durable(als_features_of(Fixtures(SparkSession.active(), folder)))


def ranked_candidates_of(fx: Fixtures) -> DataFrame:
    return _als_features(fx.spark.sparkContext.applicationId, fx.folder)


def labelled_of(fx: Fixtures) -> DataFrame:
    return lab.label_candidates(features_of(fx), val_targets(fx))


@query("rnk_01_popularity_log", "SELECT item_id, round(item_popularity_log, 6) AS item_popularity_log FROM z_item_feats")
def rnk_01(fx: Fixtures) -> DataFrame:
    return presented(feat.item_popularity(train_of(fx), fx.catalog()))


@query(
    "rnk_02_prices",
    "SELECT item_id, round(item_price_imputed, 6) AS item_price_imputed, has_price::BIGINT AS has_price FROM z_item_feats",
)
def rnk_02(fx: Fixtures) -> DataFrame:
    return presented(feat.item_prices(train_of(fx), fx.catalog()))


@query("rnk_03_recency", "SELECT item_id, round(item_recency_norm, 6) AS item_recency_norm FROM z_item_feats")
def rnk_03(fx: Fixtures) -> DataFrame:
    return presented(feat.item_recency(train_of(fx), fx.catalog()))


@query(
    "rnk_04_item_features",
    """SELECT item_id, round(item_popularity_log, 6) AS item_popularity_log, round(item_price_imputed, 6) AS item_price_imputed,
       has_price::BIGINT AS has_price, round(item_recency_norm, 6) AS item_recency_norm FROM z_item_feats""",
)
def rnk_04(fx: Fixtures) -> DataFrame:
    return presented(feat.item_features(train_of(fx), fx.catalog()))


@query("rnk_05_content_similarity", "SELECT user_id, item_id, round(content_sim, 6) + 0.0 AS content_sim FROM z_features")
def rnk_05(fx: Fixtures) -> DataFrame:
    profiles = sequences.user_profiles(train_of(fx), fx.item_embeddings())
    sims = feat.content_similarity(candidates_of(fx), profiles, fx.item_embeddings())
    return presented(sims.select("user_id", "item_id", "content_sim"))


ROUNDED_FEATURES = ", ".join(
    f"round({c}, 6) AS {c}" if c != "has_price" else "has_price::BIGINT AS has_price" for c in feat.FEATURES
)


@query("rnk_06_candidate_features", f"SELECT user_id, item_id, rank, {ROUNDED_FEATURES} FROM z_features")
def rnk_06(fx: Fixtures) -> DataFrame:
    return presented(features_of(fx))


RANKER_USERS_SQL = """SELECT user_id FROM (SELECT DISTINCT user_id FROM z_val_targets WHERE user_id IN (SELECT user_id FROM z_train))
    ORDER BY md5(concat('42:', user_id)), user_id LIMIT 600"""


def ranker_users(fx: Fixtures) -> DataFrame:
    return lab.sample_eligible(train_of(fx), val_targets(fx), 600, 42)


@query("rnk_07_ranker_users", RANKER_USERS_SQL)
def rnk_07(fx: Fixtures) -> DataFrame:
    return ranker_users(fx)


@query(
    "rnk_08_users_with_positive",
    """SELECT user_id, item_id, rank FROM z_val_cands WHERE user_id IN (
         SELECT c.user_id FROM z_val_cands c JOIN z_val_targets t ON t.user_id = c.user_id AND t.item_id = c.item_id)""",
)
def rnk_08(fx: Fixtures) -> DataFrame:
    kept = lab.keep_users_with_positive(candidates_of(fx), val_targets(fx))
    return presented(kept.select("user_id", "item_id", "rank"))


@query("rnk_09_labels", "SELECT user_id, item_id, rank, label::BIGINT AS label FROM z_labelled")
def rnk_09(fx: Fixtures) -> DataFrame:
    return presented(lab.label_candidates(candidates_of(fx), val_targets(fx)).select("user_id", "item_id", "rank", "label"))


INJECTED_SQL = """SELECT user_id, item_id, score, 0 AS injected FROM z_val_cands UNION ALL
    SELECT t.user_id, t.item_id, f.score, 1 FROM z_val_targets t JOIN (SELECT user_id, min(score) AS score FROM z_val_cands GROUP BY user_id) f USING (user_id)
    WHERE (t.user_id, t.item_id) NOT IN (SELECT user_id, item_id FROM z_val_cands)"""


@query(
    "rnk_10_injected_positives",
    f"SELECT user_id, item_id, round(score, 6) AS score, injected::BIGINT AS injected FROM ({INJECTED_SQL})",
)
def rnk_10(fx: Fixtures) -> DataFrame:
    return presented(lab.inject_positives(candidates_of(fx), val_targets(fx)))


@query(
    "dia_14_injection_report",
    f"""SELECT count(*) AS n_positive, CAST(sum(injected) AS BIGINT) AS n_injected, round(CAST(sum(injected) AS DOUBLE) / count(*), 6) AS injected_share
        FROM ({INJECTED_SQL}) JOIN z_val_targets USING (user_id, item_id)""",
)
def dia_14_injection(fx: Fixtures) -> DataFrame:
    injected = lab.inject_positives(candidates_of(fx), val_targets(fx))
    return presented(dia.injection_report(lab.label_candidates(injected, val_targets(fx))))


@query("rnk_11_group_sizes", "SELECT user_id, count(*) AS group_size FROM z_val_cands GROUP BY user_id")
def rnk_11(fx: Fixtures) -> DataFrame:
    return presented(lab.group_sizes(candidates_of(fx)))


@lru_cache(maxsize=8)
def _training_table(application: str, folder: str, held_out: bool) -> DataFrame:
    """Labelled ALS candidates of the users that have a retrieved positive, written once per session: of the sampled users,
    if others are ``held_out`` to be served, or else of all."""
    from pyspark.sql import SparkSession

    fx = Fixtures(SparkSession.active(), folder)
    rows = lab.label_candidates(ranked_candidates_of(fx), val_targets(fx))
    if held_out:
        rows = rows.join(ranker_users(fx), "user_id", "left_semi")
    return durable(lab.keep_users_with_positive(rows, val_targets(fx)))


def training_of(fx: Fixtures, held_out: bool = True) -> DataFrame:
    return _training_table(fx.spark.sparkContext.applicationId, fx.folder, held_out)


@lru_cache(maxsize=8)
def _ranker(application: str, folder: str, held_out: bool):
    from pyspark.sql import SparkSession

    return rr.fit_gbt_ranker(training_of(Fixtures(SparkSession.active(), folder), held_out))


def ranker_of(fx: Fixtures, held_out: bool = True):
    """The trees fitted on the sampled users, so that the others can be served without a leak, or on all users."""
    return _ranker(fx.spark.sparkContext.applicationId, fx.folder, held_out)


SCALES = ", ".join(f"CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}" for c in feat.FEATURES)
MARGINS = ", ".join(f"round(sign * (p.{c} - n.{c}) / s.s_{c}, 6) + 0.0 AS {c}" for c in feat.FEATURES)


@query(
    "rnk_12_margin_examples",
    f"""WITH scales AS (SELECT {SCALES} FROM z_labelled),
         ideal AS (SELECT user_id, list_sum(list_transform(range(1, CAST(sum(label) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS g
                   FROM z_labelled GROUP BY user_id)
       SELECT p.user_id, p.item_id, n.item_id AS other_id, {MARGINS}, CASE WHEN sign > 0 THEN 1 ELSE 0 END::BIGINT AS label,
              round(abs(1.0 / log2(p.rank + 1) - 1.0 / log2(n.rank + 1)) / i.g, 6) AS weight
       FROM z_labelled p JOIN z_labelled n ON n.user_id = p.user_id AND n.label = 0 JOIN ideal i ON i.user_id = p.user_id
       CROSS JOIN scales s CROSS JOIN (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) v(sign) WHERE p.label = 1""",
)
def rnk_12_examples(fx: Fixtures) -> DataFrame:
    df = presented(rr.margin_examples(durable(labelled_of(fx))))
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in feat.FEATURES}).withColumn("has_price", F.col("has_price").cast("double"))


@query("rnk_12_gbt_scores")
def rnk_12(fx: Fixtures) -> DataFrame:
    return presented(rr.scored(ranked_candidates_of(fx), ranker_of(fx, held_out=False)))


@query("rnk_12_linear_scores")
def rnk_12_linear(fx: Fixtures) -> DataFrame:
    train = training_of(fx)
    return presented(rr.scored(ranked_candidates_of(fx), rr.fit_linear_ranker(train), rr.feature_scales(train)))


@query("rnk_13_importances")
def rnk_13(fx: Fixtures) -> DataFrame:
    return presented(rr.importances(ranker_of(fx, held_out=False)))


@query("rnk_14_rerank")
def rnk_14(fx: Fixtures) -> DataFrame:
    held_out = evaluation.without_training_users(ranked_candidates_of(fx), ranker_users(fx))
    return presented(rr.rerank(held_out, ranker_of(fx)))


@query(
    "rnk_15_held_out_targets",
    f"SELECT user_id, item_id FROM z_val_targets WHERE user_id NOT IN ({RANKER_USERS_SQL})",
)
def rnk_15(fx: Fixtures) -> DataFrame:
    return evaluation.without_training_users(val_targets(fx), ranker_users(fx))


@query("rnk_16_response_sweep")
def rnk_16(fx: Fixtures) -> DataFrame:
    return presented(rr.response_sweep(ranked_candidates_of(fx), ranker_of(fx, held_out=False), "item_recency_norm", [0.0, 0.25, 0.5, 0.75, 1.0]))


# A fixed linear ranker, so that movement by a ranker's score can be checked in SQL.
FIXED_WEIGHTS = {"content_sim": 2.0, "item_popularity_log": -0.5, "item_recency_norm": 1.0, "item_price_imputed": 0.25}
FIXED_SCORE = " + ".join(f"{w}::DOUBLE * {c}" for c, w in FIXED_WEIGHTS.items())


@query(
    "rnk_17_rank_movement",
    f"""SELECT a.user_id, a.item_id, c.rank AS rank_before, a.rank AS rank_after FROM (
         SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round({FIXED_SCORE}, 6) DESC, item_id) AS rank FROM z_features) a
       JOIN z_val_cands c ON c.user_id = a.user_id AND c.item_id = a.item_id
       JOIN z_val_targets t ON t.user_id = a.user_id AND t.item_id = a.item_id WHERE a.rank <= 10 AND c.rank >= 20""",
)
def rnk_17(fx: Fixtures) -> DataFrame:
    rows = durable(features_of(fx))
    after = compose.ranked(rr.linear_scores(rows, FIXED_WEIGHTS))
    return presented(lab.rank_movement(candidates_of(fx), after, val_targets(fx)))


@query("snk_05_ranker_artefacts", RANKER_USERS_SQL)
def snk_05(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "ranker")
    writers.save_ranker(ranker_of(fx), ranker_users(fx), path)
    return fx.spark.read.parquet(f"{path}/training_users")


def fitted_tiers(fx: Fixtures, train: DataFrame, als=None) -> dict:
    """What the retrieval tiers learn from the train rows, fitted and staged once for all contexts that are served."""
    tokens = fitted_tokens_of(fx)
    return {
        "popular": durable(pop.popularity(train)),
        "als": als or factors.fit_als(train),
        "vectors": durable(fx.item_embeddings().withColumnRenamed("embedding", "vector")),
        "successors": tr.successor_lists(tr.fit_transitions(train)),
        "tokens": tokens,
        "model": tm.fit_token_model(train, tokens, LEVELS + 1),
    }


def tier_lists(fitted: dict, users: DataFrame, context: DataFrame, k: int) -> dict[str, DataFrame]:
    """The retrieval tiers on one context: popularity, ALS, dot-product scorer, transitions, semantic-id beam search."""
    seen = pop.seen_pairs(context)
    vectors, tokens = fitted["vectors"], fitted["tokens"]
    popular_lists = durable(pop.popularity_topk(fitted["popular"], users, seen, k))
    wanted = context.join(users, "user_id", "left_semi")
    return {
        "popularity": popular_lists,
        "als": factors.als_topk(fitted["als"], users, seen, k),
        "history_dot": dotscore.score_dot_topk(dotscore.history_state(wanted, vectors), vectors, seen, k),
        "transitions": tr.listed_topk(wanted, fitted["successors"], seen, popular_lists, k),
        "semantic_beam": tm.beam_topk(tm.user_contexts(wanted, tokens), fitted["model"], seen, k, k),
    }


@query("met_08_als_baseline")
def met_08_als(fx: Fixtures) -> DataFrame:
    train, targets = train_of(fx), targets_of(fx)
    users = targets.select("user_id").distinct()
    seen = pop.seen_pairs(train)
    popular = pop.popularity_topk(pop.popularity(train), users, seen, 20)
    served = durable(compose.with_fallback(factors.als_topk(als_of(fx), users, seen, 20), popular))
    parts = [
        metrics.labelled(metrics.evaluate(served, targets.where(F.col("split") == s)), s, "als") for s in ("val", "test")
    ]
    return presented(metrics.union_results(parts))


@query("met_09_unified_run")
def met_09(fx: Fixtures) -> DataFrame:
    train, targets = durable(train_of(fx)), durable(targets_of(fx))
    wanted = {}
    for split in ("val", "test"):
        part = targets.where(F.col("split") == split)
        if split == "val":  # the reranker saw labels of this split only
            part = evaluation.without_training_users(part, ranker_users(fx))
        sample = durable(evaluation.sample_users(part, 2000, 42))
        wanted[split] = durable(evaluation.restrict(part, sample).select("user_id", "item_id"))
    # A list depends on its own user and the train rows only, so both samples are served at once.
    users = durable(wanted["val"].unionByName(wanted["test"]).select("user_id").distinct())
    tiers = tier_lists(fitted_tiers(fx, train, als_of(fx)), users, train, 100)
    tiers = {name: durable(recs) for name, recs in tiers.items()}
    candidates = feat.candidate_features(tiers["als"], train, fx.catalog(), fx.item_embeddings())
    tiers["als_reranked"] = durable(rr.rerank(candidates, ranker_of(fx)))
    parts = [evaluation.run_tiers(tiers, part, split, tiers["popularity"]) for split, part in wanted.items()]
    return presented(metrics.union_results(parts))


@query("met_10_loo_run")
def met_10(fx: Fixtures) -> DataFrame:
    loo = durable(splitting.loo_split(fx.interactions()))
    train = loo.where(F.col("split") == "train")
    fitted = fitted_tiers(fx, train)
    parts = []
    for split in ("val", "test"):
        wanted = loo.where(F.col("split") == split).select("user_id", "item_id")
        context = splitting.loo_context(loo, split)
        tiers = tier_lists(fitted, wanted.select("user_id"), context, 20)
        tiers = {name: durable(recs) for name, recs in tiers.items()}
        tiers["not_trained"] = None
        parts.append(evaluation.run_tiers(tiers, wanted, split, tiers["popularity"], (5, 10, 20), ("recall", "ndcg")))
    return presented(metrics.union_results(parts))


@query("met_11_same_candidates")
def met_11(fx: Fixtures) -> DataFrame:
    held_out = evaluation.without_training_users(val_targets(fx), ranker_users(fx))
    rows = durable(ranked_candidates_of(fx).join(held_out.select("user_id").distinct(), "user_id", "left_semi"))
    before = rows.select("user_id", "item_id", F.col("als_score").alias("score"), "rank")
    return presented(evaluation.run_tiers({"retrieval": before, "reranked": rr.rerank(rows, ranker_of(fx))}, held_out, "val", None, (10, 20, 100)))


@query("dia_02_shuffled_control")
def dia_02_control(fx: Fixtures) -> DataFrame:
    """Beam search on the users' own contexts and on another user's: the control must not do better."""
    train = durable(train_of(fx))
    targets, contexts = dia.pseudo_loo(train)
    tokens = fitted_tokens_of(fx)
    model = tm.fit_token_model(train, tokens, LEVELS + 1)
    nobody = targets.where(F.lit(False))
    parts = []
    for name, ctx in (("own", contexts), ("shuffled", dia.shuffled_contexts(durable(contexts)))):
        first = tokens.select("item_id", F.col("tok1").alias("x"))
        users = ctx.where(F.col("age") == 0).join(first, "item_id").select("user_id", "x")
        recs = tm.beam_topk(users, model, nobody, 20, 20)
        parts.append(metrics.labelled(metrics.evaluate(recs, targets), "train", name))
    return presented(metrics.union_results(parts))
