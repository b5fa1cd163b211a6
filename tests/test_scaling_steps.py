"""Steps that must not move all rows: what is shuffled, and that odd keys keep their results."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.operators import embeddings as emb


def _expected(rows):
    """Brute force: rows of an id are one document; no id counts in the vocabulary only."""
    counts: dict = {}
    for key, text in rows:
        words = (text or "").split()
        counts.setdefault(key, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for key, c in counts.items():
        w = {t: tf * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, tf in c.items() if df[t] >= 2}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if key is not None:
            out |= {(key, t): x / norm for t, x in w.items()}
    return out


def test_tfidf_weighs_documents_where_they_lie(spark):
    rows = [(i, f"red{i % 3} blue{i % 2} red{i % 3} stone green{i}") for i in range(12)] + [(20, None), (21, "")]
    weights = emb.tfidf(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    found = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert found == pytest.approx(_expected(rows))


def test_tfidf_joins_rows_of_an_id_and_counts_those_without(spark):
    rows = [(i % 5, f"red{i % 3} blue{i % 2} stone") for i in range(9)] + [(7, "stone red1"), (None, "stone blue1"), (None, "grey stone")]
    found = {(r["id"], r["term"]): r["weight"] for r in emb.tfidf(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert found == pytest.approx(_expected(rows))


def test_svd_takes_few_passes_over_the_rows(spark, monkeypatch):
    random = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in random.zipf(1.5, 30) % 120) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = emb.tfidf(docs, "id", "text", max_features=400).localCheckpoint()
    passes, times = [], emb._gram_times
    monkeypatch.setattr(emb, "_gram_times", lambda *args: passes.append(1) or times(*args))
    vectors, _ = emb.truncated_svd(weights, "id", 8, docs)
    rows = weights.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    dense = np.zeros((150, len(terms)))
    for r in rows:
        dense[r["id"], terms[r["term"]]] = r["weight"]
    found = np.array([r["embedding"] for r in vectors.orderBy("id").collect()])
    assert len(passes) <= 12
    assert np.linalg.norm(found, axis=0) == pytest.approx(np.linalg.svd(dense)[1][:8], rel=1e-4)


def test_full_runs_fit_their_models_once_for_both_splits(fx, monkeypatch):
    from reckoner.plans import ranking_queries as rq

    fits, served = [], []

    def lists(fitted, users, context, k):
        served.append(fitted)
        return {"popularity": users.select("user_id", F.lit(1).cast("long").alias("item_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))}

    monkeypatch.setattr(rq, "fitted_tiers", lambda *given: fits.append(given) or {"number": len(fits)})
    monkeypatch.setattr(rq, "tier_lists", lists)
    rows = rq.met_10(fx).collect()
    assert len(fits) == 1 and served == [{"number": 1}] * 2
    assert {(r["split"], r["model"], r["metric"], r["k"]) for r in rows} == {
        (s, "popularity", m, k) for s in ("val", "test") for m in ("recall", "ndcg") for k in (5, 10, 20)
    }


def test_first_interactions_are_aggregated_once_for_the_loo_split(spark):
    from reckoner.operators import splitting

    rows = [(u, i, t, t, 0) for u in range(4) for t, i in enumerate([5, 6, 5, 7, 8][: 2 + u])]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts long, k1 long, k2 long")
    loo = splitting.loo_split(df)
    plan = loo._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys?=\[user_id#\d+L, item_id#\d+L\]", plan)  # read from the stage, not aggregated in each use
    got = {(r["user_id"], r["item_id"], r["split"]) for r in loo.collect()}
    assert got == {(2, 5, "train"), (2, 6, "val"), (2, 7, "test"), (3, 5, "train"), (3, 6, "train"), (3, 7, "val"), (3, 8, "test")}


def _small_shop(spark, folder):
    """Three items sold early (one of them listed twice, one also without a date), two sold late, one never, one big and so late."""
    day = "timestamp'2000-01-01' + make_dt_interval({})"
    sold = [(1, 10, "0"), (2, 11, "1"), (3, 10, "95"), (3, 12, "99"), (4, 13, "100"), (4, 15, "2"), (1, 16, "3"), (2, 16, "null")]
    lines = [f"({o}L, {i}L, 1L, 5, {day.format(d)})" for o, i, d in sold]
    tables = {
        "lineitem": f"select col1 l_orderkey, col2 l_partkey, col3 l_linenumber, col4 l_quantity, col5 l_shipdate from values {', '.join(lines)}",
        "orders": "select col1 o_orderkey, col2 o_custkey from values (1L, 7L), (2L, 7L), (3L, 8L), (4L, null)",
        "events": "select col1 user_id from values (9L), (9L), (null)",
        "part": "select col1 p_partkey, col2 p_size, 1.5D p_retailprice from values (10L, 20), (10L, 20), (11L, 5), (12L, 20), (13L, 20), (14L, 20), (15L, 45), (16L, 1)",
        "embeddings": "select id vec_id, int(id % 2) label, transform(sequence(1, 4), i -> float((id * i) % 5)) embedding from range(6)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}.parquet")


def test_cold_items_stage_item_spans_and_not_interactions(spark, tmp_path, monkeypatch):
    from reckoner.operators.ordering import stage_owner
    from reckoner.plans import catalogue
    from reckoner.sources import fixtures

    _small_shop(spark, tmp_path)
    monkeypatch.setattr(fixtures, "END_US", 947_000_000_000_000 + 10_000_000_000_000)
    with stage_owner(spark) as paths:
        rows = catalogue.QUERIES["sid_09_cold_items"](spark, str(tmp_path)).collect()
        staged = [set(spark.read.parquet(p).columns) for p in paths if "stage-" in p]
    sales = fixtures.Fixtures(spark, str(tmp_path)).interactions().collect()
    times = [r["ts"] for r in sales if r["ts"]]
    start = max(times) - 0.16 * (max(times) - min(times))
    known = {r["item_id"] for r in sales if r["ts"] and r["ts"] < start}
    assert known == {10, 11, 16}
    assert sorted(r["item_id"] for r in rows) == [12, 13, 14, 15]
    assert staged and not any("user_id" in columns for columns in staged)


def test_sales_lines_are_not_joined_by_user(fx):
    plan = fx.interactions()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "l_partkey" in joins[0] and "LeftOuter" not in joins[0] and any("LeftOuter" in line for line in joins[1:])


def test_scores_importances_and_sweep_learn_from_every_user(spark, monkeypatch):
    """700 users with a retrieved positive, more than the ranker's sample: the fits that hold nobody out read all of them."""
    from reckoner.plans import ranking_queries as rq
    from reckoner.sources.fixtures import Fixtures

    n, features = 700, {c: F.rand(i) for i, c in enumerate(rq.feat.FEATURES)}
    recs = spark.range(n).selectExpr("id AS user_id", "explode(sequence(1L, 3L)) AS rank").withColumn("item_id", F.col("rank"))
    recs = recs.withColumns(features).localCheckpoint()
    targets = spark.range(n).selectExpr("id AS user_id", "1 + id % 3 AS item_id")
    fitted = []
    monkeypatch.setattr(rq, "ranked_candidates_of", lambda fx: recs)
    monkeypatch.setattr(rq, "val_targets", lambda fx: targets)
    monkeypatch.setattr(rq, "ranker_users", lambda fx: targets.select("user_id").limit(600))
    monkeypatch.setattr(rq.rr, "fit_gbt_ranker", lambda rows: fitted.append(rows.select("user_id").distinct().count()))
    monkeypatch.setattr(rq.rr, "scored", lambda rows, model: recs.limit(0))
    monkeypatch.setattr(rq.rr, "importances", lambda model: recs.limit(0))
    monkeypatch.setattr(rq.rr, "response_sweep", lambda rows, model, *a: recs.limit(0))
    for name, query in (("scores", rq.rnk_12), ("importances", rq.rnk_13), ("sweep", rq.rnk_16)):
        query(Fixtures(spark, f"no such folder: {name}"))
    assert fitted == [n, n, n]
