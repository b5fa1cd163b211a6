"""Retrieval operators against brute force."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import history
from reckoner.operators import compose, dotscore, factors, popularity as pop, token_model as tm, transitions as tr
from reckoner.operators.semantic_ids import add_dedup_digit
from reckoner.operators.tokens import item_tokens, vocabulary_for


def _by_user(df, *columns):
    out = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r["user_id"], []).append(r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 5), (3, 50)])
def test_top_unseen(spark, seed, k):
    rng = random.Random(seed)
    lists = {x: rng.sample(range(30), 20 + x) for x in range(3)}
    users = {u: rng.randrange(3) for u in range(25)}
    seen = {(u, i) for u in users for i in rng.sample(range(30), rng.randrange(28))}
    seen -= {(0, i) for i in range(30)}  # nothing seen
    seen |= {(1, i) for i in lists[users[1]]}  # everything seen
    list_df = spark.createDataFrame(
        [(x, r + 1, i, float(-r)) for x, items in lists.items() for r, i in enumerate(items)],
        "list_id int, rank long, item_id long, score double",
    )
    user_df = spark.createDataFrame(list(users.items()), "user_id long, list_id int")
    got = _by_user(compose.top_unseen(user_df, list_df, spark.createDataFrame(list(seen), "user_id long, item_id long"), k), "item_id", "rank")
    for u, x in users.items():
        expected = [i for i in lists[x] if (u, i) not in seen][:k]
        assert got.get(u, []) == [(i, r + 1) for r, i in enumerate(expected)]


def test_top_unseen_reads_only_the_head_of_the_lists_where_that_is_enough(spark):
    items = list(range(100, 160))
    list_df = spark.createDataFrame([(0, r + 1, i, -float(r)) for r, i in enumerate(items)], "list_id int, rank long, item_id long, score double")
    seen = {(u, i) for u in range(6) for i in items[u : u + 3]}
    light = spark.createDataFrame([(u, 0) for u in range(6)], "user_id long, list_id int")
    seen_df = spark.createDataFrame(sorted(seen), "user_id long, item_id long")
    top = compose.top_unseen(light, list_df, seen_df, 2, 8)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_list_rank" not in plan  # no shuffle by (list, rank), where every user wants the same few
    expected = {u: [i for i in items if (u, i) not in seen][:2] for u in range(6)}
    assert _by_user(top, "item_id") == expected

    seen |= {(6, i) for i in items[:40]} | {(7, i) for i in items[1:8]} | {(8, i) for i in items}  # the head is not enough
    users = spark.createDataFrame([(u, 0) for u in range(9)], "user_id long, list_id int")
    got = _by_user(compose.top_unseen(users, list_df, spark.createDataFrame(sorted(seen), "user_id long, item_id long"), 2, 8), "item_id", "rank")
    assert got == {u: [(i, r + 1) for r, i in enumerate([i for i in items if (u, i) not in seen][:2])] for u in range(8)}


@pytest.mark.parametrize("block", [4, 16])
def test_seen_ranks_of_one_heavy_user_are_counted_in_blocks(spark, block):
    rng = random.Random(block)
    items = rng.sample(range(1000), 200)
    seen = {(0, i) for i in items[:190]} - {(0, items[17]), (0, items[150])}  # a user who has seen nearly everything
    seen |= {(u, i) for u in range(1, 12) for i in rng.sample(items, 17)}
    list_df = spark.createDataFrame([(1, r + 1, i, 0.0) for r, i in enumerate(items)], "list_id int, rank long, item_id long, score double")
    user_df = spark.createDataFrame([(u, 1) for u in range(12)], "user_id long, list_id int")
    seen_df = spark.createDataFrame(list(seen), "user_id long, item_id long")
    got = _by_user(compose.unseen_entries(user_df, list_df, seen_df, 7, block), "item_id", "rank")
    for u in range(12):
        assert got[u] == [(i, r + 1) for r, i in enumerate([i for i in items if (u, i) not in seen][:7])]
    marks = seen_df.join(list_df, "item_id").select("user_id", "list_id", "rank")
    counted = compose.seen_before(marks, 7, block).collect()
    ranks = {u: sorted(r["rank"] for r in marks.where(F.col("user_id") == u).collect()) for u in range(12)}
    assert all(r["_before"] == ranks[r["user_id"]].index(r["rank"]) for r in counted)
    assert len(counted) < marks.count()  # blocks beyond the seventh unseen entry are left out
    assert {r["rank"] for r in counted if r["user_id"] == 0} >= {r for r in ranks[0] if r - 1 - ranks[0].index(r) < 7}


def test_popularity_order(spark):
    ranked = pop.popularity(history(spark, [(1, 5, 1), (2, 5, 2), (1, 3, 3), (1, 4, 4)]))
    assert [(r["item_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(5, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("chunk_bytes", [64, 400, 1 << 20])
def test_dot_topk_in_chunks(spark, chunk_bytes):
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(23, 4)).round(1), rng.normal(size=(31, 4)).round(1)
    items[10:20] = items[10]  # equal vectors tie to the smaller id
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 23, 150), rng.integers(0, 31, 150))}
    user_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, vector array<double>")
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<double>")
    seen_df = spark.createDataFrame(list(seen), "user_id long, item_id long")
    got = _by_user(dotscore.score_dot_topk(user_df, item_df, seen_df, 6, chunk_bytes), "item_id")
    scores = np.round(users @ items.T, 6)
    for u in range(23):
        order = sorted((i for i in range(31) if (u, i) not in seen), key=lambda i: (-scores[u, i], i))
        assert got[u] == order[:6]


def test_short_vectors_are_not_visited(spark):
    rng = np.random.default_rng(9)
    users, items = rng.normal(size=(40, 8)), rng.normal(size=(400, 8))
    items *= (0.97 ** np.arange(400))[rng.permutation(400)][:, None]
    user_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "id long, vector array<double>")
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, vector array<double>")
    seen = {(u, int(i)) for u in range(1, 40) for i in rng.integers(0, 400, 30)} | {(0, i) for i in range(400) if i % 100}
    seen_df = spark.createDataFrame(list(seen), "id long, other long")
    chunk_bytes, k = 8 * 8 * 25, 5
    found = dotscore.blocked_topk(user_df, item_df, seen_df, k, chunk_bytes)
    named = found.select(F.col("left_id").alias("user_id"), F.col("right_id").alias("item_id"), "score")
    got = _by_user(compose.ranked(named, k), "item_id")
    scores = np.round(users @ items.T, 6)
    for u in range(40):
        order = sorted((i for i in range(400) if (u, i) not in seen), key=lambda i: (-scores[u, i], i))
        assert got[u] == order[:k]
    right, n = dotscore.norm_chunks(item_df, chunk_bytes)
    head = found.join(right.where("rc = 0").select(F.col("id").alias("right_id")), "right_id")
    pairs = dotscore.reaching(user_df, head, right, k).groupBy("id").count().collect()
    visited = {r["id"]: r["count"] for r in pairs}
    assert n == 16 and visited[0] == 15  # user 0 has only four unseen items: every chunk is read
    assert sum(visited.values()) < 40 * 15 / 2


@pytest.mark.parametrize("chunk_bytes", [8 * 24 * 10, 1 << 20])
def test_hashed_neighbours_against_exact_lists(spark, chunk_bytes):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 600)] + 0.25 * rng.normal(size=(600, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 24), (901, None)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    got = {}
    for r in dotscore.hashed_cosine_topk(df, df, 8, near=0.85, recall=0.95, bits=6, chunk_bytes=chunk_bytes).collect():
        got.setdefault(r["query_id"], {})[r["item_id"]] = r["score"]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -2)
    hits = total = 0
    for u in range(600):
        best = [i for i in sorted(range(600), key=lambda i: (-scores[u, i], i))[:8] if scores[u, i] >= 0.85]
        hits, total = hits + sum(i in got.get(u, {}) for i in best), total + len(best)
        assert all(abs(scores[u, i] - s) < 2e-6 for i, s in got.get(u, {}).items())
        assert u not in got.get(u, {}) and len(got.get(u, {})) <= 8
    assert total > 1000 and hits >= 0.95 * total
    assert not {900, 901} & set(got)
    assert dotscore.tables_for(0.9, 0.99, 8) > dotscore.tables_for(0.9, 0.9, 8) > dotscore.tables_for(0.99, 0.9, 8)


def test_score_pairs(spark):
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(9, 3)), rng.normal(size=(8, 3))
    pairs = [(a, b) for a, b in product(range(9), range(8)) if (a + b) % 2] + [(99, 1), (1, 99)]
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    got = dotscore.score_pairs(frame(left), frame(right), spark.createDataFrame(pairs, "id long, other long"), chunk_bytes=72).collect()
    assert {(r[0], r[1]): pytest.approx(r[2]) for r in got} == {p: left[p[0]] @ right[p[1]] for p in pairs[:-2]}


def test_cosine_topk_same_table_twice(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "item_id long, embedding array<double>")
    got = dotscore.cosine_topk(vectors, vectors, 1).select("query_id", "item_id")
    assert dict(map(tuple, got.collect())) == {1: 2, 2: 1, 3: 2}


def test_als_lists_hold_no_seen_items_and_dense_ranks(spark):
    rng = random.Random(4)
    train = history(spark, [(u, rng.randrange(20), t) for t, u in enumerate([u for u in range(15) for _ in range(8)])])
    model = factors.fit_als(train, factors=4, iterations=3)
    users = spark.createDataFrame([(u,) for u in range(18)], "user_id long")
    seen = pop.seen_pairs(train)
    recs = factors.als_topk(model, users, seen, 5)
    assert recs.join(seen, ["user_id", "item_id"]).isEmpty()
    ranks = recs.groupBy("user_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert len(ranks) == 15 and all(r["r"] == [1, 2, 3, 4, 5] for r in ranks)


def test_fallback_only_for_users_without_list(spark):
    schema = "user_id long, item_id long, score double, rank int"
    own = spark.createDataFrame([(1, 7, 1.0, 1)], schema)
    other = spark.createDataFrame([(1, 8, 1.0, 1), (2, 8, 1.0, 1)], schema)
    assert _by_user(compose.with_fallback(own, other), "item_id") == {1: [7], 2: [8]}
    filled = compose.filled_up(own, spark.createDataFrame([(1, 7, 9.0, 1), (1, 8, 8.0, 2), (2, 3, 1.0, 1)], schema), 2)
    assert _by_user(filled, "item_id") == {1: [7, 8], 2: [3]}


def test_transition_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    t = tr.fit_transitions(history(spark, [(rng.randrange(5), rng.randrange(6), i) for i in range(100)]))
    assert all(abs(r[1] - 1) < 1e-9 for r in t.groupBy("item_id").agg(F.sum("probability")).collect())


def _transition_lists(rows, seen, k):
    """Every user's top k by first principles, with scores."""
    users, counts = {}, {}
    for u, i, _ in rows:
        users.setdefault(u, []).append(i)
    for items in users.values():
        for a, b in zip(items, items[1:]):
            counts.setdefault(a, {}).setdefault(b, 0)
            counts[a][b] += 1
    out = {}
    for u, items in users.items():
        scores = {}
        for age, a in enumerate(items[::-1][: tr.LAST_ITEMS]):
            for b, n in counts.get(a, {}).items():
                scores[b] = scores.get(b, 0.0) + tr.DECAY**age * n / sum(counts[a].values())
        kept = [(-float(np.float32(s)), b) for b, s in scores.items() if (u, b) not in seen]
        out[u] = [(b, -s) for s, b in sorted(kept)[:k]]
    return out


@pytest.mark.parametrize("seed, first_depth", [(1, 1), (2, 3), (1, None)])
def test_transition_rounds_are_exact(spark, seed, first_depth):
    rng = random.Random(seed)
    # item 0 is a third of all rows, so its successor list is long
    rows = [(rng.randrange(12), 0 if rng.random() < 0.34 else min(rng.randrange(40), rng.randrange(40)), t) for t in range(900)]
    df = history(spark, rows)
    seen = df.where("k1 < 500").select("user_id", "item_id").distinct().where("item_id < 12")
    nobody = spark.createDataFrame([], "user_id long, item_id long, score double, rank int")
    got = _by_user(tr.transition_topk(df, tr.fit_transitions(df), seen, nobody, 6, first_depth), "item_id", "score")
    wanted = _transition_lists(rows, {tuple(r) for r in seen.collect()}, 6)
    assert {u: [i for i, _ in entries] for u, entries in got.items()} == {u: [i for i, _ in entries] for u, entries in wanted.items()}
    for u, entries in got.items():
        assert [s for _, s in entries] == pytest.approx([s for _, s in wanted[u]], rel=1e-6)


def test_transition_lists_are_not_opened_whole(spark, monkeypatch):
    """A list of 3,000 falling probabilities below one millionth of the first: ranks follow them, and few entries are read."""
    lists = spark.range(3000).selectExpr("7L as item_id", "id as next_item", "1L as n", "pow(0.99D, id) * 1e-9 as probability")
    df = history(spark, [(1, 7, 1), (2, 7, 1)])
    seen = spark.range(40).selectExpr("2L as user_id", "id as item_id")
    nobody = spark.createDataFrame([], "user_id long, item_id long, score double, rank int")
    depths = []
    opened = tr._opened_to
    monkeypatch.setattr(tr, "_opened_to", lambda active, lists, seen, k, depth: depths.append((depth, active.count())) or opened(active, lists, seen, k, depth))
    got = _by_user(tr.transition_topk(df, lists, seen, nobody, 5), "item_id")
    assert got == {1: [0, 1, 2, 3, 4], 2: [40, 41, 42, 43, 44]}
    assert depths == [(20, 2), (80, 1)]  # the user who has seen 40 entries goes on alone


@pytest.fixture(scope="module")
def token_setup(spark):
    rng = random.Random(12)
    codes = [(i, rng.randrange(3), rng.randrange(2)) for i in range(14)]
    sids = add_dedup_digit(spark.createDataFrame(codes, "item_id long, sid_level_1 int, sid_level_2 int"))
    tokens = item_tokens(sids, vocabulary_for(sids))
    rows = [(rng.randrange(6), rng.randrange(14), t) for t in range(90)]
    model = tm.fit_token_model(history(spark, rows), tokens, 3)
    table = {r["item_id"]: (r["tok1"], r["tok2"], r["tok3"]) for r in tokens.collect()}
    return rows, tokens, model, table


def _brute_probability(rows, table):
    """P(token | x, prefix) from first principles."""
    last, pairs = {}, []
    for u, i, _ in rows:
        if u in last:
            pairs.append((table[last[u]][0], table[i]))
        last[u] = i
    children = {}
    for t in table.values():
        for d in range(3):
            children.setdefault(t[:d], set()).add(t[d])

    def p(x, prefix, token):
        d = len(prefix)
        match = [t for _, t in pairs if t[:d] == prefix]
        q = (sum(t[d] == token for t in match) + 1) / (len(match) + len(children[prefix]))
        own = [t for y, t in pairs if y == x and t[:d] == prefix]
        return (sum(t[d] == token for t in own) + tm.KAPPA * q) / (len(own) + tm.KAPPA)

    return p, children


def test_token_probabilities_sum_to_one(token_setup):
    rows, _, _, table = token_setup
    p, children = _brute_probability(rows, table)
    for x in {t[0] for t in table.values()}:
        for prefix, tokens in children.items():
            assert sum(p(x, prefix, t) for t in tokens) == pytest.approx(1)


@pytest.mark.parametrize("beam", [1, 2, 4, 14])
def test_beam_search_matches_brute_force(spark, token_setup, beam):
    rows, tokens, model, table = token_setup
    p, children = _brute_probability(rows, table)
    items = {t: i for i, t in table.items()}
    contexts = spark.createDataFrame([(x,) for x in {t[0] for t in table.values()}], "x int")
    got = {}
    for r in tm.beam_search(contexts, model, beam).orderBy("list_id", "rank").collect():
        got.setdefault(r["list_id"], []).append(r["item_id"])
    for x in got:
        beams = [((), 0.0)]
        for _ in range(3):
            grown = [(path + (t,), round(lp + math.log(p(x, path, t)), tm.LOG_DIGITS)) for path, lp in beams for t in children[path]]
            beams = sorted(grown, key=lambda b: (-b[1], b[0]))[:beam]
        assert got[x] == [items[path] for path, _ in beams]
    if beam == 14:
        assert all(len(v) == 14 for v in got.values())  # wide enough: full enumeration


def test_beam_topk_is_not_cut_short_by_seen_items(spark, token_setup):
    rows, tokens, model, table = token_setup
    users = spark.createDataFrame([(1, min(t[0] for t in table.values()))], "user_id long, x int")
    everything = tm.beam_search(users, model, 14).orderBy("rank").collect()
    seen = spark.createDataFrame([(1, r["item_id"]) for r in everything[:9]], "user_id long, item_id long")
    got = _by_user(tm.beam_topk(users, model, seen, 5, 14), "item_id")
    assert got[1] == [r["item_id"] for r in everything[9:14]]


def test_a_heavy_user_lengthens_no_other_list(spark, token_setup):
    """One user has seen the whole catalogue: the others' lists stay as they are without that user."""
    rows, tokens, model, table = token_setup
    digits = sorted({t[0] for t in table.values()})
    users = spark.createDataFrame([(u, digits[u % len(digits)]) for u in range(6)], "user_id long, x int")
    seen = [(u, i) for u in range(1, 6) for i in range(u)]
    lengths = {}
    for name, pairs in (("without", seen), ("with", seen + [(0, i) for i in table])):
        pairs = spark.createDataFrame(pairs, "user_id long, item_id long")
        assigned, lists = tm.user_lists(users, model, pairs, 2, 14)
        sizes = lists.groupBy("list_id").agg(F.count("*").alias("n"))
        lengths[name] = {r["user_id"]: r["n"] for r in assigned.join(sizes, "list_id").collect()}
        got = _by_user(tm.beam_topk(users, model, pairs, 2, 14), "item_id")
        everything = tm.beam_search(users, model, 14).orderBy("rank").collect()
        hidden = {(r["user_id"], r["item_id"]) for r in pairs.collect()}
        for u in range(6):
            own = [r["item_id"] for r in everything if r["list_id"] == digits[u % len(digits)] and (u, r["item_id"]) not in hidden]
            assert got.get(u, []) == own[:2]
    assert {u: lengths["with"][u] for u in range(1, 6)} == {u: lengths["without"][u] for u in range(1, 6)}
    assert lengths["with"][0] == 14 and max(lengths["without"].values()) < 14


def test_listed_pairs_keep_their_columns(spark):
    """Every pair comes back once with its own columns, whatever they are called; a missing vector gives null."""
    rng = np.random.default_rng(7)
    left, right = rng.normal(size=(5, 4)), rng.normal(size=(30, 4))
    pairs = [(a, b, a * 100 + b, "x") for a in range(5) for b in range(30) if a == 0 or b % 3 == a % 3] + [(99, 1, 7, "x"), (1, 99, 8, None)]
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    df = spark.createDataFrame(pairs, "id long, other long, vector long, score string")
    for chunk_bytes in (64, 1 << 20):
        rows = dotscore.score_listed(frame(left), frame(right), df, chunk_bytes, name="dot").collect()
        got = {(r["id"], r["other"]): (r["vector"], r["score"], r["dot"]) for r in rows}
        assert len(rows) == len(pairs)
        for a, b, v, s in pairs:
            dot = pytest.approx(left[a] @ right[b]) if a < 5 and b < 30 else None
            assert got[a, b] == (v, s, dot)
    assert dotscore.score_listed(frame(left), frame(right), df.where("false")).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e200])
def test_blocked_product_equals_the_full_one(scale):
    """Tiles and floors: many equal scores, hidden cells, rows with a given floor, and numbers beyond single precision."""
    rng = np.random.default_rng(5)
    left, right = np.round(rng.normal(size=(40, 6)), 1), np.round(rng.normal(size=(30, 6)), 1)[rng.integers(0, 30, 3000)]
    left[0], right[0] = 0.0, 0.0
    if scale > 1:
        left[1], right[:2] = left[1] / scale, right[:2] * scale
    hidden_rows = np.repeat(np.arange(40), 50)
    hidden_cols = np.concatenate([rng.choice(3000, 50, replace=False) for _ in range(40)])
    full = np.round(left @ right.T, 6) + 0.0
    full[hidden_rows, hidden_cols] = -np.inf
    floors = np.where(np.arange(40) % 2 == 0, -np.inf, np.sort(full, axis=1)[:, -4])
    expected = []
    for i in range(40):
        best = [c for c in np.lexsort((np.arange(3000), -full[i])) if np.isfinite(full[i, c]) and full[i, c] >= floors[i]][:7]
        expected += [(i, c) for c in best]
    old_cells, dotscore.TILE_CELLS = dotscore.TILE_CELLS, 4_000
    try:
        rows, cols, scores = dotscore._block_topk(left, right, floors, (hidden_rows, hidden_cols), 7)
    finally:
        dotscore.TILE_CELLS = old_cells
    assert sorted(zip(rows.tolist(), cols.tolist())) == sorted(expected)
    assert np.allclose(scores, full[rows, cols])


def test_later_chunks_return_only_what_reaches_the_floor(spark):
    """A later chunk gives no row that the first chunk's k-th score already shuts out."""
    rng = np.random.default_rng(6)
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    left, right = rng.normal(size=(50, 4)), rng.normal(size=(400, 4))
    nothing = spark.createDataFrame([], "id long, other long")
    found = dotscore.blocked_topk(frame(left), frame(right), nothing, 5, chunk_bytes=8 * 4 * 40).collect()
    chunks = 10
    assert len(found) < 50 * 5 * 3 < 50 * 5 * chunks
    full = np.round(left @ right.T, 6)
    for i in range(50):
        got = sorted((-r["score"], r["right_id"]) for r in found if r["left_id"] == i)[:5]
        assert [c for _, c in got] == np.lexsort((np.arange(400), -full[i]))[:5].tolist()


def test_blocks_of_the_factorisation_follow_the_ratings(spark):
    """Every block gets nearly all factors of the other side, so their number must not follow the cores."""
    assert factors._blocks(0) == factors._blocks(29_000_000) == factors.FEWEST_BLOCKS < 10
    assert factors._blocks(100 * factors.BLOCK_RATINGS) == 100


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 8 * 3 * 7])
def test_weighted_means_move_no_vector_per_row(spark, chunk_bytes):
    """Repeated items and rows, null ids, items without a vector; one chunk and many."""
    rng = np.random.default_rng(8)
    vectors = [(i % 25, rng.normal(size=3).tolist()) for i in range(30)] + [(40, None), (None, [1.0, 1.0, 1.0])]
    rows = [(int(u) if u else None, int(i), float(w)) for u, i, w in zip(rng.integers(0, 9, 300), rng.integers(0, 35, 300), rng.integers(1, 4, 300))]
    rows += [(50, 34, 1.0), (50, 40, 1.0), (51, None, 1.0)]
    right = spark.createDataFrame(vectors, "id long, vector array<float>")
    got = dotscore.weighted_means(spark.createDataFrame(rows, "id long, other long, weight double"), right, chunk_bytes).collect()
    expected = {}
    for u, i, w in rows:
        for j, v in vectors:
            if i is not None and i == j and v is not None:
                total = expected.setdefault(u, [np.zeros(3), 0.0])
                total[0] += w * np.array(v, dtype="float32").astype(float)
                total[1] += w
    assert len(got) == len(expected) and None in expected and 50 not in expected
    for r in got:
        assert np.allclose(r["vector"], expected[r["id"]][0] / expected[r["id"]][1])


@pytest.mark.parametrize("block_bytes", [factors.BLOCK_BYTES, 4 * 4 * 12])
def test_als_steps_equal_mllib_and_leave_no_step_behind(spark, monkeypatch, block_bytes):
    """Also with tasks that hold twelve factors, to which only those that they name are sent; a heavy user has several rows."""
    import os

    from pyspark.ml.recommendation import ALS

    from reckoner.operators.ordering import shared_folder

    monkeypatch.setattr(factors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(factors, "PACKED_ENTRIES", 7)
    monkeypatch.setattr(factors, "PACKED_IDS", 3)
    rng = random.Random(6)
    users = [u for u in range(25) for _ in range(6)] + [99] * 40
    train = history(spark, [(u, rng.randrange(40), t) for t, u in enumerate(users)])
    counts = train.groupBy("user_id", "item_id").count().selectExpr("int(user_id) u", "int(item_id) i", "float(count) n")
    als = ALS(rank=4, regParam=0.05, maxIter=3, alpha=40.0, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="n", seed=42, numUserBlocks=6, numItemBlocks=6)
    expected = als.fit(counts)
    before = {f for f in os.listdir(shared_folder(spark)) if f.startswith("round-")}
    model = factors.fit_als(train, factors=4, iterations=3)
    assert {f for f in os.listdir(shared_folder(spark)) if f.startswith("round-")} == before
    for got, want in ((model.userFactors, expected.userFactors), (model.itemFactors, expected.itemFactors)):
        got, want = ({r["id"]: r["features"] for r in df.collect()} for df in (got, want))
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-4, abs=1e-5) for i in want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_topk_in_passes_of_few_chunks_equals_brute_force(spark, monkeypatch, kind):
    """Equal norms, so that no chunk can be left out; a pass takes one chunk and hands on no more than k entries a row."""
    monkeypatch.setattr(dotscore, "PASS_BYTES", 1, raising=False)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype("float32")
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, vector array<{kind}>")
    itself = df.select("id", F.col("id").alias("other"))
    found = dotscore.blocked_topk(df, df, itself, 3, chunk_bytes=4 * 4 * 13)
    assert found.groupBy("left_id").count().where("count > 6").isEmpty()
    score = np.round(x.astype("float64") @ x.astype("float64").T, 6)
    np.fill_diagonal(score, -9)
    expected = {(i, j) for i in range(60) for j in np.lexsort((np.arange(60), -score[i]))[:3].tolist()}
    best = compose.ranked(found.withColumn("item_id", F.col("right_id")), 3, keys=("left_id",))
    assert {(r["left_id"], r["right_id"]) for r in best.collect()} == expected


def test_weighted_means_emit_sums_in_pieces(spark, monkeypatch):
    """A task's sums go on while it runs, all pairs of an id in one piece, also of an id with more pairs than a piece takes."""
    import pyarrow as pa

    monkeypatch.setattr(dotscore, "PAIRS_AT_ONCE", 5, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10, 3)).astype("float32")
    pairs = [(u, int(o), 1.0 + u) for u in range(12) for o in rng.choice(10, 9 if u == 4 else 2, replace=False)] + [(50, 77, 1.0)]
    names = ["id", "other", "weight", "vector"]
    rows = [(None, i, None, v.tolist()) for i, v in enumerate(x)] + [(*p, None) for p in pairs]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float32())]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[s : s + 4]], t) for c, t in enumerate(kinds)], names) for s in range(0, len(rows), 4)]
    found = list(dotscore._sum_rows(iter(batches[::-1])))
    assert len(found) > 4 and max(b.num_rows for b in found) <= 2 + 1
    got = {u: (v, w) for b in found for u, v, w in zip(*(c.to_pylist() for c in b.columns))}
    assert got.keys() == set(range(12))
    for u, (v, w) in got.items():
        mine = [(o, n) for a, o, n in pairs if a == u]
        assert w == pytest.approx(sum(n for _, n in mine)) and v == pytest.approx(sum(n * x[o].astype(float) for o, n in mine))
