"""Sources, sinks, ranking invariants and the registered contract."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_DIR, history
from oracle_check import compare, oracle_connection
from reckoner.operators import diagnostics as dia, embeddings as emb, evaluation, labels as lab, metrics, reranker as rr, semantic_ids as sid
from reckoner.plans import ranking_queries as rq
from reckoner.schemas import INTERACTIONS, check_schema
from reckoner.sources import readers, writers

SAMPLE = (
    "src_02_read_metadata src_03_flatten_text_arrays cln_01_clean_retail cln_03_clean_ratings dim_01_item_catalog dim_05_encode_ids "
    "spl_02_split_stats spl_04_loo_split spl_06_loo_stats seq_01_user_sequences seq_04_padded_tails emb_01_tfidf emb_05_cosine_neighbours "
    "emb_06_statistics sid_02_quantise sid_09_cold_items tok_03_token_streams tok_06_prefix_table ret_03_popularity_topk ret_10_dot_topk "
    "ret_12_transition_topk ret_15_beam_unseen rnk_06_candidate_features rnk_12_margin_examples met_04_evaluate met_10_loo_popularity "
    "dia_02_shuffled_contexts dia_09_gap_days"
).split()


def _names():
    return sorted(entry.oracle_sql()) if os.environ.get("RECKONER_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ret_03_popularity_topk", "ret_10_dot_topk", "met_04_evaluate", "rnk_06_candidate_features", "spl_04_loo_split"])
def test_plans_have_no_pairwise_joins(fx, spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_schema_contract(fx):
    check_schema(fx.interactions(), INTERACTIONS)
    with pytest.raises(TypeError, match="user_id"):
        check_schema(fx.interactions().drop("user_id"), INTERACTIONS)


def test_metadata_lines_with_missing_keys(spark, tmp_path):
    lines = [
        {"parent_asin": "A", "title": "t", "price": 5.5, "categories": ["x", "y"], "description": []},
        {"parent_asin": "B", "price": "from 9", "extra": 1},
    ]
    path = tmp_path / "meta.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    df = readers.flatten_text_arrays(readers.read_metadata(spark, str(path)), ["categories", "features", "description"])
    rows = {r["parent_asin"]: r for r in df.collect()}
    assert (rows["A"]["categories"], rows["A"]["features"], rows["A"]["description"]) == ("x y", "", "")
    assert (rows["A"]["price"], rows["B"]["price"], rows["B"]["title"]) == ("5.5", "from 9", None)


def test_export_flattens_lists_and_skips_missing(spark, tmp_path):
    spark.createDataFrame([(1, [3, 4])], "user_id long, item_ids array<long>").write.parquet(str(tmp_path / "t"))
    written = writers.export_csv(spark, {"t": str(tmp_path / "t"), "no": str(tmp_path / "no")}, str(tmp_path / "csv"))
    assert written == ["t"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "t")).first()["item_ids"] == "3 4"


def test_merge_results_replaces_keys(spark):
    schema = "split string, metric string, value double"
    old = spark.createDataFrame([("val", "a", 1.0), ("test", "a", 2.0)], schema)
    new = spark.createDataFrame([("val", "a", 9.0)], schema)
    merged = writers.merge_results(old, new, ["split", "metric"])
    assert sorted(map(tuple, merged.collect())) == [("test", "a", 2.0), ("val", "a", 9.0)]


def test_sampling_is_repeatable_and_bounded(spark):
    users = spark.range(500).withColumnRenamed("id", "user_id")
    a = {r[0] for r in evaluation.sample_users(users, 40, 7).collect()}
    b = {r[0] for r in evaluation.sample_users(users.repartition(7), 40, 7).collect()}
    assert a == b and len(a) == 40
    assert a != {r[0] for r in evaluation.sample_users(users, 40, 8).collect()}


def test_shuffled_contexts_form_a_ring(spark):
    contexts = spark.createDataFrame([(1, 10, 0), (5, 50, 0), (9, 90, 0)], "user_id long, item_id long, age int")
    got = {r["user_id"]: r["item_id"] for r in dia.shuffled_contexts(contexts).collect()}
    assert got == {1: 50, 5: 90, 9: 10}


def test_pseudo_loo(spark):
    targets, contexts = dia.pseudo_loo(history(spark, [(1, i, i) for i in range(15)] + [(2, 1, 1), (2, 2, 2), (2, 3, 3)]))
    assert [tuple(r) for r in targets.collect()] == [(1, 14)]
    assert sorted((r["age"], r["item_id"]) for r in contexts.collect()) == [(a, 13 - a) for a in range(9)]


def test_reranking_keeps_candidates_and_recall_at_depth(fx, spark):
    rows = rq.features_of(fx)
    labelled = lab.label_candidates(rows, rq.val_targets(fx))
    model = rr.fit_gbt_ranker(labelled, trees=3)
    reranked = rr.rerank(rows, model)
    before = rows.select("user_id", "item_id", "rank")
    assert reranked.select("user_id", "item_id").exceptAll(before.select("user_id", "item_id")).isEmpty()
    recall = [metrics.evaluate(r, rq.val_targets(fx), (100,), ("recall",)).first()["value"] for r in (before, reranked)]
    assert recall[0] == pytest.approx(recall[1])
    assert rr.importances(model).count() == 7


def test_leak_guard_is_disjoint(fx):
    users = rq.ranker_users(fx)
    held_out = evaluation.without_training_users(rq.val_targets(fx), users)
    assert held_out.join(users, "user_id").isEmpty()


def test_fitted_codebooks_reduce_the_error(fx):
    scaled, _ = emb.standardise(fx.item_embeddings())
    books = sid.fit_residual_codebooks(scaled, levels=2, k=8, iters=5)
    assert books.count() <= 16
    errors = {r["level"]: r["mean_distance"] for r in sid.level_errors(sid.quantise(scaled, books)).collect()}
    assert errors[2] < errors[1]


def test_mean_pairwise_cosine_equals_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(12, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = ((u @ u.T).sum() - 12) / (12 * 11)
    assert emb.mean_pairwise_cosine(df).first()["mean_cosine"] == pytest.approx(expected)


def test_svd_keeps_inner_products(spark):
    texts = ["red ring small", "red ring large", "blue ring small", "blue chain large", "green chain small", "green chain large"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = emb.tfidf(docs, "doc_id", "text", min_df=1)
    n_terms = weights.select("term").distinct().count()
    vectors, explained = emb.truncated_svd(weights, "doc_id", min(6, n_terms))
    assert explained == pytest.approx(1.0, abs=1e-6)
    norms = vectors.select(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)).collect()
    assert all(r[0] == pytest.approx(1.0, abs=1e-6) for r in norms)


def test_interactions_are_staged_once_per_query_and_block(spark, fx):
    """Bounds, train and targets of one query read one table; a block that deletes its stages leaves none behind."""
    from reckoner.operators.ordering import stage_owner
    from reckoner.plans.retrieval_queries import targets_of
    from reckoner.plans.sequence_queries import train_of
    from reckoner.sources.fixtures import Fixtures

    own = Fixtures(spark, fx.folder)
    with stage_owner(spark) as paths:
        assert targets_of(own).count() and train_of(own).count()
        assert len(paths) == 1
    plan = train_of(own)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert own.staged_interactions().count() == fx.interactions().count()
