"""Skew-safe numbering, hot keys and staging against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import history
from reckoner.operators import dimensions, ordering, sequences, splitting
from reckoner.operators.ordering import durable, positions, shared_folder, stage_owner
from reckoner.operators.semantic_ids import add_dedup_digit


def _rows(n_users=6, n=400, hot=0, seed=3):
    """A third of all rows belongs to user ``hot``."""
    rng = random.Random(seed)
    return [(hot if rng.random() < 0.34 else rng.randrange(n_users), rng.randrange(12), t) for t in range(n)]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    rows = ordering.global_index(df, [F.col("v")], "i").collect()
    assert all(r["v"] == r["i"] for r in rows) and len(rows) == 1000


def test_positions_match_python(spark):
    rows = _rows()
    df = history(spark, rows)
    got = {(r["user_id"], r["k1"]): r["pos"] for r in ordering.positions(df, ["user_id"], ["k1"]).collect()}
    expected, counters = {}, {}
    for u, _, t in rows:
        expected[(u, t)] = counters.get(u, 0)
        counters[u] = expected[(u, t)] + 1
    assert got == expected


def test_successors_hot_and_ordinary_agree(spark):
    df = history(spark, _rows())
    plain = ordering.successors(df, "user_id", sequences.SEQ_ORDER, "item_id").collect()
    split = ordering.successors(df, "user_id", sequences.SEQ_ORDER, "item_id", limit=60).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, split)) and len(plain) == 400 - 6


def test_hot_user_sequence_continues_in_parts(spark):
    rows = _rows()
    df = history(spark, rows)
    parts = sequences.user_sequences(df, limit=50).orderBy("user_id", "part").collect()
    joined = {}
    for r in parts:
        assert len(r["item_ids"]) <= 80
        joined.setdefault(r["user_id"], []).extend(r["item_ids"])
    assert max(r["part"] for r in parts) >= 2
    expected = {}
    for u, i, _ in rows:
        expected.setdefault(u, []).append(i)
    assert joined == expected


def test_staged_folders_go_with_their_owner(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    rows = spark.createDataFrame([(i % 7, i) for i in range(50)], "k long, v long")
    with stage_owner(spark) as outer:
        kept = durable(rows)
        with pytest.raises(ZeroDivisionError), stage_owner(spark):
            assert positions(rows, ["k"], [F.col("v")]).count() == 50
            raise ZeroDivisionError
        assert set(os.listdir(folder)) - before == {os.path.basename(p) for p in outer}
        assert kept.count() == 50
    assert set(os.listdir(folder)) == before
    durable(rows)
    assert len(set(os.listdir(folder)) - before) == 1  # without an owner nothing is deleted


def test_dense_ids_follow_key_order(spark):
    df = spark.createDataFrame([(f"k{i % 50:03d}",) for i in range(500)] + [(None,)], "key string")
    ids = {r["key"]: r["id"] for r in dimensions.dense_ids(df, "key", "id").collect()}
    assert ids == {f"k{i:03d}": i for i in range(50)}


def test_dedup_digit_with_one_dominant_tuple(spark):
    rows = [(i, 1, 1) if i % 3 == 0 else (i, i, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, sid_level_1 int, sid_level_2 int")
    got = {r["item_id"]: r["sid_dedup"] for r in add_dedup_digit(df).collect()}
    assert got == {i: (i // 3 if i % 3 == 0 else 0) for i in range(300)}


def test_dedup_digit_continues_after_taken(spark):
    schema = "item_id long, sid_level_1 int, sid_level_2 int"
    taken = add_dedup_digit(spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 2)], schema))
    new = spark.createDataFrame([(10, 1, 1), (11, 1, 1), (12, 9, 9)], schema)
    assert {r["item_id"]: r["sid_dedup"] for r in add_dedup_digit(new, taken).collect()} == {10: 2, 11: 3, 12: 0}


def test_loo_split_matches_python(spark):
    rows = _rows(n=200, seed=11) + [(77, 1, 1000), (77, 2, 1001)]
    got = {(r["user_id"], r["item_id"]): r["split"] for r in splitting.loo_split(history(spark, rows)).collect()}
    expected = {}
    for user in {u for u, _, _ in rows}:
        items = list(dict.fromkeys(i for u, i, _ in rows if u == user))
        if len(items) >= 3:
            for place, item in enumerate(items):
                expected[(user, item)] = {len(items) - 1: "test", len(items) - 2: "val"}.get(place, "train")
    assert got == expected and not any(u == 77 for u, _ in got)


def test_canonical_value(spark):
    rows = [("a", "x")] * 2 + [("a", "y")] * 2 + [("a", None)] * 9 + [("b", None)]
    df = spark.createDataFrame(rows, "code string, title string")
    got = dict(map(tuple, dimensions.canonical_value(df, "code", "title").collect()))
    assert got == {"a": "x", "b": "UNKNOWN"}


def test_scratch_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert ordering.scratch_path(spark, "x").startswith(folder)
    assert ordering.durable(spark.range(5)).count() == 5
    assert any(name.startswith("stage-") for name in os.listdir(folder))


def test_list_parts_survive_write_read_and_export(spark, tmp_path):
    """With rows of three elements every user has several parts, a hot user too; written, read back and exported, the parts
    of a user still make the one list in order."""
    from reckoner.sources import readers, writers

    rows = _rows()
    df = history(spark, rows)
    expected, targets = {}, {}
    for u, i, _ in rows:
        expected.setdefault(u, []).append(i)
        targets.setdefault(u, set()).add(i)
    for lists, whole in ((sequences.user_sequences(df, 3), expected), (sequences.target_sets(df, 3), {u: sorted(t) for u, t in targets.items()})):
        stage, out = str(tmp_path / f"stage{len(lists.columns)}"), str(tmp_path / f"out{len(lists.columns)}")
        writers.write_stage(lists, stage)
        writers.export_csv(spark, {"lists": stage}, out)
        exported = spark.read.option("header", True).csv(f"{out}/lists").collect()
        stored = readers.read_stage(spark, stage).orderBy("user_id", "part").collect()
        assert max(len(r["item_ids"]) for r in stored) == 3
        got = {}
        for r in stored:
            assert r["part"] * 3 == len(got.get(r["user_id"], []))
            got.setdefault(r["user_id"], []).extend(r["item_ids"])
        assert got == whole
        again = {}
        for r in sorted(exported, key=lambda r: (int(r["user_id"]), int(r["part"]))):
            again.setdefault(int(r["user_id"]), []).extend(map(int, r["item_ids"].split()))
        assert again == whole
