"""Exact quantiles against numpy, with a key that holds a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.operators.features import item_prices
from reckoner.operators.quantiles import exact_quantiles, value_counts

SHARES = {"low": 0.0, "q": 0.37, "half": 0.5, "high": 0.95, "top": 1.0}


def _rows(n=3000, seed=5):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.choice([None, round(rng.gauss(0, 1), 1), rng.gauss(0, 9)])) for _ in range(n)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_quantiles_equal_numpy(spark, partitions):
    rows = _rows() + [(77, None), (78, 4.0), (79, float("inf")), (79, 1.0), (79, 2.0)]
    df = spark.createDataFrame(rows, "key int, x double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["key"]: r for r in exact_quantiles(df, ["key"], "x", SHARES).collect()}
        whole = exact_quantiles(df.where("key < 70"), [], "x", SHARES).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    values = {}
    for key, x in rows:
        if x is not None:
            values.setdefault(key, []).append(x)
    assert set(got) == set(values)
    for key, xs in values.items():
        if key != 79:
            assert [got[key][c] for c in SHARES] == pytest.approx([np.quantile(xs, q) for q in SHARES.values()], abs=1e-12)
    assert got[79]["half"] == 2.0 and got[79]["low"] == 1.0 and got[79]["top"] == float("inf")
    everything = [x for key, xs in values.items() if key < 70 for x in xs]
    assert [whole[0][c] for c in SHARES] == pytest.approx([np.quantile(everything, q) for q in SHARES.values()], abs=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "key int, x double")
    assert exact_quantiles(none, ["key"], "x", {"half": 0.5}).count() == 0
    assert value_counts(none, ["key"], "x").count() == 0


def test_price_medians_with_free_values(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.random() * 100) for _ in range(2000)] + [(9, None)]
    train = spark.createDataFrame(rows, "item_id long, unit_price double")
    catalog = spark.range(12).select(F.col("id").alias("item_id"))
    got = {r["item_id"]: r for r in item_prices(train, catalog).collect()}
    overall = np.median([p for _, p in rows if p is not None])
    for item in range(12):
        own = [p for i, p in rows if i == item and p is not None]
        assert got[item]["has_price"] == bool(own)
        assert got[item]["item_price_imputed"] == pytest.approx(np.median(own) if own else overall, abs=1e-12)
