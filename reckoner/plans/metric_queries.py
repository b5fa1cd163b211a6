"""Metrics and evaluation protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.operators import evaluation, metrics, popularity as pop, splitting
from reckoner.operators.ordering import durable
from reckoner.plans.ctes import metrics_sql
from reckoner.plans.registry import presented, query
from reckoner.plans.retrieval_queries import popularity_recs, targets_of
from reckoner.plans.sequence_queries import split_of, targets_in, train_in, train_of
from reckoner.sources.fixtures import Fixtures

VAL_TARGETS = "SELECT user_id, item_id FROM z_targets WHERE split = 'val'"
TEST_TARGETS = "SELECT user_id, item_id FROM z_targets WHERE split = 'test'"
POP_RECS = "SELECT user_id, item_id, rank FROM z_pop_recs"
KS = (5, 10, 20)


def _val(fx: Fixtures) -> DataFrame:
    return targets_of(fx).where(F.col("split") == "val").select("user_id", "item_id")


def _metric(fx: Fixtures, name: str) -> DataFrame:
    return presented(metrics.evaluate(popularity_recs(fx), _val(fx), KS, (name,)))


@query("met_01_recall", metrics_sql(POP_RECS, VAL_TARGETS, KS, ("recall",)))
def met_01(fx: Fixtures) -> DataFrame:
    return _metric(fx, "recall")


@query("met_02_ndcg", metrics_sql(POP_RECS, VAL_TARGETS, KS, ("ndcg",)))
def met_02(fx: Fixtures) -> DataFrame:
    return _metric(fx, "ndcg")


@query("met_03_map", metrics_sql(POP_RECS, VAL_TARGETS, KS, ("map",)))
def met_03(fx: Fixtures) -> DataFrame:
    return _metric(fx, "map")


@query("met_04_evaluate", metrics_sql(POP_RECS, TEST_TARGETS, (10, 20), metrics.METRICS))
def met_04(fx: Fixtures) -> DataFrame:
    test = targets_of(fx).where(F.col("split") == "test")
    return presented(metrics.evaluate(popularity_recs(fx), test))


def _both_splits(fx: Fixtures) -> DataFrame:
    split = durable(split_of(fx))
    train, targets = train_in(split), targets_in(split)
    popular = pop.popularity(train)
    parts = [
        evaluation.popularity_baseline(popular, train, targets.where(F.col("split") == s), s) for s in ("val", "test")
    ]
    return metrics.union_results(parts)


BASELINE_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS split, 'popularity' AS model, * FROM ({metrics_sql(POP_RECS, t, (10, 20), metrics.METRICS)})"
    for s, t in (("val", VAL_TARGETS), ("test", TEST_TARGETS))
)


@query(
    "met_05_comparison",
    "SELECT split, model, "
    + ", ".join(f"max(CASE WHEN metric = '{m}' AND k = {k} THEN value END) AS {m}_{k}" for m in metrics.METRICS for k in (10, 20))
    + f" FROM ({BASELINE_SQL}) GROUP BY split, model",
)
def met_05(fx: Fixtures) -> DataFrame:
    return presented(metrics.compare(_both_splits(fx), (10, 20)))


@query(
    "met_06_warm_sample",
    """SELECT DISTINCT user_id FROM z_targets WHERE split = 'val' AND user_id IN (SELECT user_id FROM z_train)
       ORDER BY md5(concat('42:', user_id)), user_id LIMIT 400""",
)
def met_06(fx: Fixtures) -> DataFrame:
    return evaluation.warm_sample(_val(fx), train_of(fx), 400, 42)


SAMPLE_SQL = """SELECT user_id FROM (SELECT DISTINCT user_id FROM z_targets WHERE split = 'val')
    ORDER BY md5(concat('7:', user_id)), user_id LIMIT 500"""


@query(
    "met_07_all_user_sample",
    f"""SELECT count(*) AS n_sample, count_if(user_id NOT IN (SELECT user_id FROM z_train)) AS n_cold,
        round(CAST(count_if(user_id NOT IN (SELECT user_id FROM z_train)) AS DOUBLE) / count(*), 6) AS cold_share FROM ({SAMPLE_SQL})""",
)
def met_07(fx: Fixtures) -> DataFrame:
    sample = evaluation.sample_users(_val(fx), 500, 7)
    return presented(evaluation.sample_report(sample, train_of(fx)))


@query(
    "met_07_sampled_targets",
    f"SELECT user_id, item_id FROM z_targets WHERE split = 'val' AND user_id IN ({SAMPLE_SQL})",
)
def met_07_targets(fx: Fixtures) -> DataFrame:
    return evaluation.restrict(_val(fx), evaluation.sample_users(_val(fx), 500, 7))


@query("met_08_popularity_baseline", BASELINE_SQL)
def met_08(fx: Fixtures) -> DataFrame:
    return presented(_both_splits(fx))


def loo_parts(loo: DataFrame):
    """Per split of the leave-one-out protocol: targets and context rows."""
    for split in ("val", "test"):
        yield split, loo.where(F.col("split") == split).select("user_id", "item_id"), splitting.loo_context(loo, split)


LOO_RECS_SQL = """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
    FROM (SELECT DISTINCT user_id FROM z_loo) u CROSS JOIN z_loo_pop p
    WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 20"""


@query(
    "met_10_loo_popularity",
    " UNION ALL ".join(
        f"SELECT '{s}' AS split, 'popularity' AS model, * FROM ("
        + metrics_sql(LOO_RECS_SQL.format(seen=seen), f"SELECT user_id, item_id FROM z_loo WHERE split = '{s}'", KS, ("recall", "ndcg"))
        + ")"
        for s, seen in (("val", "z_loo_train"), ("test", "z_loo_seen_test"))
    ),
)
def met_10(fx: Fixtures) -> DataFrame:
    loo = durable(splitting.loo_split(fx.interactions()))
    popular = pop.popularity(loo.where(F.col("split") == "train"))
    parts = [
        evaluation.popularity_baseline(popular, context, targets, split, KS, ("recall", "ndcg"))
        for split, targets, context in loo_parts(loo)
    ]
    return presented(metrics.union_results(parts))
