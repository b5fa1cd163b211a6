"""Worked examples with known results."""

import math

import pytest
from pyspark.sql import functions as F

from reckoner.functions.scalars import pad_tail, parse_price
from reckoner.operators import metrics, semantic_ids as sid, tokens as tok


def _value(spark, ranked, relevant, metric, k):
    recs = spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ranked)], "user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(1, i) for i in relevant], "user_id long, item_id long")
    return metrics.evaluate(recs, targets, (k,), (metric,)).first()["value"]


@pytest.mark.parametrize(
    "k, recall, ndcg, ap", [(3, 0.5, 0.386853, 0.25), (5, 0.5, 0.386853, 0.25), (7, 1.0, 0.605260, 0.416667)]
)
def test_list_metrics(spark, k, recall, ndcg, ap):
    letters = {c: i for i, c in enumerate("ABCDEFGHIJKLMN")}
    ranked = [letters[c] for c in "GEHJKMN"]
    relevant = [letters["E"], letters["M"]]
    assert _value(spark, ranked, relevant, "recall", k) == pytest.approx(recall, abs=1e-6)
    assert _value(spark, ranked, relevant, "ndcg", k) == pytest.approx(ndcg, abs=1e-6)
    assert _value(spark, ranked, relevant, "map", k) == pytest.approx(ap, abs=1e-6)


@pytest.mark.parametrize("ranked, ap", [([1, 2, 9, 8], 1.0), ([1, 9, 8, 2], 0.75)])
def test_average_precision(spark, ranked, ap):
    assert _value(spark, ranked, [1, 2], "map", 4) == pytest.approx(ap)


@pytest.mark.parametrize("place", [1, 2, 10])
def test_single_hit_ndcg(spark, place):
    ranked = [100 + i for i in range(10)]
    assert _value(spark, ranked, [ranked[place - 1]], "ndcg", 10) == pytest.approx(1 / math.log2(place + 1))


def test_user_without_list_scores_zero(spark):
    recs = spark.createDataFrame([(1, 5, 1)], "user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(1, 5), (2, 6)], "user_id long, item_id long")
    row = metrics.evaluate(recs, targets, (10,), ("recall",)).first()
    assert (row["value"], row["n_users"]) == (0.5, 2)


def test_parse_price(spark):
    texts = ["from 14.99", "1,014.99", ",", None, "n/a", "7"]
    df = spark.createDataFrame([(t,) for t in texts], "price string")
    assert [r[0] for r in df.select(parse_price(F.col("price"))).collect()] == [14.99, 1014.99, None, None, None, 7.0]


def test_pad_tail(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(pad_tail(F.col("a"), 3, 0)).collect()] == [[2, 3, 4], [1, 0, 0], [0, 0, 0]]


def test_residual_quantisation(spark):
    books = spark.createDataFrame(
        [
            (1, 0, [0.2, 0.9]),
            (1, 1, [0.8, 0.2]),
            (1, 2, [-0.5, -0.5]),
            (2, 0, [-0.1, 0.1]),
            (2, 1, [0.3, 0.3]),
            (2, 2, [0.0, -0.4]),
        ],
        sid.CODEBOOK_SCHEMA,
    )
    z = spark.createDataFrame([(7, [0.72, 0.31])], "item_id long, embedding array<double>")
    for quantised in (sid.quantise(z, books), sid.quantise_expression(z, books, 2)):
        row = quantised.first()
        assert list(row["codes"]) == [1, 0]
        assert row["distances"][0] == pytest.approx(0.08**2 + 0.11**2)
    rebuilt = sid.reconstruct(sid.quantise(z, books), books, 2).first()["reconstructed"]
    assert rebuilt == pytest.approx([0.7, 0.3])


def test_lowest_code_wins_ties(spark):
    books = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [-1.0]), (1, 2, [1.0])], sid.CODEBOOK_SCHEMA)
    z = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "item_id long, embedding array<double>")
    assert {r["item_id"]: r["codes"][0] for r in sid.quantise(z, books).collect()} == {1: 0, 2: 0}


def test_token_layout(spark):
    ids = spark.createDataFrame([(9, 3, 4, 5, 6)], "item_id long, sid_level_1 int, sid_level_2 int, sid_level_3 int, sid_dedup int")
    vocabulary = tok.Vocabulary(levels=3, dedup_size=21)
    assert tuple(tok.item_tokens(ids, vocabulary).first())[1:] == (3, 256 + 4, 512 + 5, 768 + 6)
    assert vocabulary.pad == 789
    assert tok.Vocabulary(levels=3, dedup_size=21, user_buckets=2000).pad == 2789


def test_token_range_is_checked(spark):
    ids = spark.createDataFrame([(9, 3, 4, 5, 21)], "item_id long, sid_level_1 int, sid_level_2 int, sid_level_3 int, sid_dedup int")
    with pytest.raises(Exception, match="sid_dedup outside"):
        tok.item_tokens(ids, tok.Vocabulary(levels=3, dedup_size=21)).collect()
