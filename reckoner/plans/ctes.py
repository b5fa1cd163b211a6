"""Named SQL building blocks for the checking queries.

A checking query names the blocks it needs; ``with_ctes`` adds them and what they depend on, in order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                needed.append(name)
                visit(CTES[name])

    visit(sql)
    blocks = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    sql = sql.strip()
    if not blocks:
        return sql
    head = f"WITH {', '.join(blocks)}"
    return f"{head}, {sql[5:]}" if sql.startswith("WITH ") else f"{head} {sql}"


# Input views.
cte("z_late_users", "SELECT DISTINCT user_id FROM events")
cte(
    "z_sales",
    """SELECT l.*, o.*, p.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey""",
)
cte(
    "z_inter",
    """SELECT s.o_custkey AS user_id, s.l_partkey AS item_id, CAST(s.l_orderkey AS VARCHAR) AS invoice_id,
       CAST(s.l_quantity AS BIGINT) AS quantity, CASE WHEN s.p_size > 12 THEN s.p_retailprice END AS unit_price,
       CASE WHEN s.p_size > 40 OR e.user_id IS NOT NULL
            THEN 1004832000000000 - ((1004832000000000 - epoch_us(s.l_shipdate)) * 15) // 100
            ELSE epoch_us(s.l_shipdate) END AS us,
       s.l_orderkey AS k1, CAST(s.l_linenumber AS BIGINT) AS k2
       FROM z_sales s LEFT JOIN z_late_users e ON e.user_id = s.o_custkey""",
)
cte(
    "z_retail",
    """SELECT CASE WHEN o_orderstatus = 'F' AND l_linenumber = 1 THEN 'C' || CAST(l_orderkey AS VARCHAR)
            ELSE CAST(l_orderkey AS VARCHAR) END AS InvoiceNo,
       'P' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS StockCode,
       CASE WHEN p_size = 50 THEN NULL WHEN l_linenumber IN (3, 6) THEN upper(p_name) ELSE p_name END AS Description,
       CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS Quantity,
       l_shipdate AS InvoiceDate, p_retailprice AS UnitPrice,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS CustomerID
       FROM z_sales""",
)
cte(
    "z_retail_clean",
    "SELECT * FROM z_retail WHERE CustomerID IS NOT NULL AND InvoiceNo NOT LIKE 'C%' AND Quantity > 0",
)
cte(
    "z_rating_rows",
    """SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS user_id,
       'B' || lpad(CAST(item_id AS VARCHAR), 9, '0') AS parent_asin, CAST(quantity AS DOUBLE) AS rating,
       us // 1000 AS "timestamp", k1, k2 FROM z_inter""",
)
cte(
    "z_ratings",
    """SELECT * FROM z_rating_rows
       UNION ALL SELECT user_id, parent_asin, rating, "timestamp", k1, k2 + 100 FROM z_rating_rows WHERE rating = 50
       UNION ALL SELECT NULL, parent_asin, rating, "timestamp", k1, k2 + 200 FROM z_rating_rows WHERE rating = 1""",
)
cte(
    "z_ratings_clean",
    """SELECT * FROM z_ratings WHERE user_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin, "timestamp" ORDER BY k1, k2) = 1""",
)
cte(
    "z_meta",
    """SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS parent_asin,
       CASE WHEN p_size <> 50 THEN concat_ws(' ', p_brand, p_type, p_name) END AS title,
       CASE WHEN p_size <= 12 THEN NULL
            WHEN p_size IN (14, 21, 28, 35, 42, 49) THEN 'from 1,' || CAST(p_size AS VARCHAR) || '4.99'
            WHEN p_size IN (22, 33, 44) THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS price,
       concat_ws(' ', p_brand, p_type) AS categories, CASE WHEN p_size <> 50 THEN p_name ELSE '' END AS features
       FROM part""",
)
cte(
    "z_catalog",
    """SELECT p_partkey AS item_id, 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS stock_code,
       concat_ws(' ', p_brand, p_type, p_name) AS description FROM part""",
)
cte(
    "z_emb",
    """SELECT p.p_partkey AS item_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM part p JOIN embeddings e ON e.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings)""",
)
cte(
    "z_event_inter",
    """SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, epoch_us(ts) AS us, event_id AS k1
       FROM events WHERE event_type IN ('view', 'purchase')""",
)

# Splits.
cte("z_span", "SELECT min(us) AS lo, max(us) AS hi FROM z_inter")
cte(
    "z_bounds",
    """SELECT lo, hi, hi - CAST(0.16 AS DOUBLE) * (hi - lo) AS val_start,
       hi - CAST(0.08 AS DOUBLE) * (hi - lo) AS test_start FROM z_span""",
)
cte(
    "z_split",
    """SELECT i.*, CASE WHEN us < (SELECT val_start FROM z_bounds) THEN 'train'
       WHEN us < (SELECT test_start FROM z_bounds) THEN 'val' ELSE 'test' END AS split FROM z_inter i""",
)
cte("z_train", "SELECT * FROM z_split WHERE split = 'train'")
cte("z_eval", "SELECT * FROM z_split WHERE split <> 'train'")
cte("z_targets", "SELECT DISTINCT split, user_id, item_id FROM z_eval")
cte("z_seen", "SELECT DISTINCT user_id, item_id FROM z_train")
cte(
    "z_first",
    """SELECT user_id, item_id, us, k1, k2 FROM z_inter
       QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY us, k1, k2) = 1""",
)
cte(
    "z_loo",
    """SELECT user_id, item_id, us, k1, k2, CASE WHEN rn = 1 THEN 'test' WHEN rn = 2 THEN 'val' ELSE 'train' END AS split
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) AS rn,
                    count(*) OVER (PARTITION BY user_id) AS n FROM z_first) WHERE n >= 3""",
)

# Popularity retrieval.
cte(
    "z_pop",
    """SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS rank
       FROM (SELECT item_id, count(*) AS n FROM z_train GROUP BY item_id)""",
)
cte("z_eval_users", "SELECT DISTINCT user_id FROM z_targets")
cte(
    "z_pop_recs",
    """SELECT user_id, item_id, CAST(n AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
       FROM z_eval_users u CROSS JOIN z_pop p
       WHERE NOT EXISTS (SELECT 1 FROM z_seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 20""",
)
cte("z_loo_train", "SELECT * FROM z_loo WHERE split = 'train'")
cte("z_loo_seen_test", "SELECT DISTINCT user_id, item_id FROM z_loo WHERE split IN ('train', 'val')")
cte(
    "z_loo_pop",
    """SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS rank
       FROM (SELECT item_id, count(*) AS n FROM z_loo_train GROUP BY item_id)""",
)


def metrics_sql(recs: str, targets: str, ks: tuple[int, ...], metrics: tuple[str, ...]) -> str:
    """Tidy (metric, k, value, n_users) of a recommendation query against a target query."""
    expr = {
        "recall": "CAST(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS DOUBLE) / max(n)",
        "ndcg": """coalesce(sum(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) END), 0)
                   / list_sum(list_transform(range(1, least(max(n), {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))""",
        "map": "coalesce(sum(CASE WHEN rank <= {k} THEN CAST(h AS DOUBLE) / rank END), 0) / least(max(n), {k})",
    }
    base = f"""SELECT t.user_id, r.rank, count(*) OVER (PARTITION BY t.user_id) AS n,
        row_number() OVER (PARTITION BY t.user_id ORDER BY r.rank NULLS LAST) AS h
        FROM ({targets}) t LEFT JOIN ({recs}) r ON r.user_id = t.user_id AND r.item_id = t.item_id"""
    parts = [
        f"""SELECT '{m}' AS metric, {k}::BIGINT AS k, round(avg(x), 6) AS value, count(*) AS n_users
            FROM (SELECT user_id, {expr[m].format(k=k)} AS x FROM ({base}) GROUP BY user_id)"""
        for m in metrics
        for k in ks
    ]
    return " UNION ALL ".join(parts)

# Ranking candidates: popularity top 100 of the val users, score 1 / rank.
cte(
    "z_cands",
    """SELECT user_id, item_id, 1.0::DOUBLE / rank AS score, rank FROM (
         SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
         FROM z_eval_users u CROSS JOIN z_pop p
         WHERE NOT EXISTS (SELECT 1 FROM z_seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 100)""",
)

# Vectors, codebooks and semantic ids (64 dimensions in the test tables).
cte(
    "z_vec",
    """SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, (SELECT count(*) FROM embeddings) AS n FROM embeddings""",
)
# Vectors scaled by the statistics of the items that were sold in the training span.
cte(
    "z_frozen_std",
    """SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM (
         SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM z_emb WHERE item_id IN (SELECT item_id FROM z_train)) GROUP BY i)""",
)
cte(
    "z_vec_scaled",
    """SELECT vec_id, label, list_transform(list_zip(v, s.m, s.s), lambda z: (z[1] - z[2]) / (z[3] + 1e-8::DOUBLE)) AS v, n
       FROM z_vec CROSS JOIN z_frozen_std s""",
)
cte("z_item_vec", "SELECT p_partkey AS item_id, p_partkey % (SELECT count(*) FROM embeddings) AS vec_id FROM part")
for _end in ("", "_scaled"):
    cte(
        f"z_book_groups{_end}",
        f"""SELECT 1 AS level, CAST(label AS BIGINT) AS code, v FROM z_vec{_end}
           UNION ALL SELECT 2, vec_id * 16 // n, v FROM z_vec{_end} UNION ALL SELECT 3, vec_id * 8 // n, v FROM z_vec{_end}""",
    )
    cte(
        f"z_book{_end}",
        f"""SELECT level, code, list(m ORDER BY i) AS c FROM (SELECT level, code, i, avg(x) AS m FROM (
             SELECT level, code, unnest(range(1, 65)) AS i, unnest(v) AS x FROM z_book_groups{_end}) GROUP BY level, code, i)
           GROUP BY level, code""",
    )
    _previous = f"z_vec{_end}"
    for _level, _name in ((1, f"z_q_one{_end}"), (2, f"z_q_two{_end}"), (3, f"z_q_three{_end}")):
        _kept = "".join(f", c{j}, d{j}" for j in range(1, _level))
        _vector = "v" if _level == 1 else "r"
        cte(
            _name,
            f"""SELECT vec_id, list_transform(list_zip({_vector}, c), lambda z: z[1] - z[2]) AS r{_kept},
                code AS c{_level}, d * d AS d{_level} FROM (
                  SELECT q.*, b.code, b.c, list_distance(q.{_vector}, b.c) AS d FROM {_previous} q JOIN z_book{_end} b ON b.level = {_level})
                QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1""",
        )
        _previous = _name
cte(
    "z_sid",
    """SELECT i.item_id, q.c1, q.c2, q.c3, q.d1, q.d2, q.d3, q.r,
       row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY i.item_id) - 1 AS dedup FROM z_item_vec i JOIN z_q_three q USING (vec_id)""",
)
cte("z_tok", "SELECT item_id, c1 AS tok1, 256 + c2 AS tok2, 512 + c3 AS tok3, 768 + dedup AS tok4 FROM z_sid")
cte("z_std_long", "SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM z_emb) GROUP BY i")
cte("z_std", "SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM z_std_long")

# Next-token model: pairs of consecutive train items, counts per depth.
cte(
    "z_pairs",
    """SELECT user_id, item_id AS a, lead(item_id) OVER (PARTITION BY user_id ORDER BY us, k1, k2, item_id) AS b FROM z_train""",
)
cte(
    "z_tok_paths",
    """SELECT item_id, tok1 AS x, [tok1] AS p1, [tok1, tok2] AS p2, [tok1, tok2, tok3] AS p3, [tok1, tok2, tok3, tok4] AS p4,
       tok1, tok2, tok3, tok4 FROM z_tok""",
)
cte(
    "z_steps",
    """SELECT item_id, 0 AS depth, CAST([] AS BIGINT[]) AS prefix, tok1 AS token FROM z_tok
       UNION ALL SELECT item_id, 1, [tok1], tok2 FROM z_tok UNION ALL SELECT item_id, 2, [tok1, tok2], tok3 FROM z_tok
       UNION ALL SELECT item_id, 3, [tok1, tok2, tok3], tok4 FROM z_tok""",
)
cte("z_children", "SELECT depth, prefix, token, count(*) AS n_items, CASE WHEN depth = 3 THEN min(item_id) END AS item_id FROM z_steps GROUP BY depth, prefix, token")
cte(
    "z_observed",
    """SELECT s.depth, t.tok1 AS x, s.prefix, s.token, count(*) AS n FROM z_pairs p JOIN z_tok t ON t.item_id = p.a
       JOIN z_steps s ON s.item_id = p.b GROUP BY s.depth, t.tok1, s.prefix, s.token""",
)
cte("z_totals", "SELECT depth, x, prefix, sum(n) AS total FROM z_observed GROUP BY depth, x, prefix")
cte(
    "z_q",
    """SELECT c.depth, c.prefix, c.token, c.item_id, (coalesce(o.n, 0) + 1.0::DOUBLE) / (sum(coalesce(o.n, 0)) OVER w + count(*) OVER w) AS q
       FROM z_children c LEFT JOIN (SELECT depth, prefix, token, sum(n) AS n FROM z_observed GROUP BY depth, prefix, token) o
         ON o.depth = c.depth AND o.prefix = c.prefix AND o.token = c.token
       WINDOW w AS (PARTITION BY c.depth, c.prefix)""",
)
cte("z_contexts", "SELECT DISTINCT tok1 AS x FROM z_tok")
cte(
    "z_prob",
    """SELECT q.depth, c.x, q.prefix, q.token, q.item_id, (coalesce(o.n, 0) + 5.0::DOUBLE * q.q) / (coalesce(t.total, 0) + 5.0::DOUBLE) AS p
       FROM z_q q CROSS JOIN z_contexts c
       LEFT JOIN z_observed o ON o.depth = q.depth AND o.x = c.x AND o.prefix = q.prefix AND o.token = q.token
       LEFT JOIN z_totals t ON t.depth = q.depth AND t.x = c.x AND t.prefix = q.prefix""",
)
BEAM = 20
_beam_source = "(SELECT x, CAST([] AS BIGINT[]) AS path, 0.0::DOUBLE AS logp FROM z_contexts)"
for _depth, _name in enumerate(("z_beam_one", "z_beam_two", "z_beam_three", "z_beam_all")):
    _cut = "" if _name == "z_beam_all" else f"QUALIFY row_number() OVER (PARTITION BY x ORDER BY logp DESC, path) <= {BEAM}"
    cte(
        _name,
        f"""SELECT * FROM (SELECT b.x, list_append(b.path, p.token) AS path, p.item_id, round(b.logp + ln(p.p), 9) AS logp
            FROM {_beam_source} b JOIN z_prob p ON p.depth = {_depth} AND p.x = b.x AND p.prefix = b.path) {_cut}""",
    )
    _beam_source = _name
cte(
    "z_beam_lists",
    "SELECT x, item_id, logp, row_number() OVER (PARTITION BY x ORDER BY logp DESC, path) AS rank FROM z_beam_all",
)
cte(
    "z_user_x",
    """SELECT n.user_id, t.tok1 AS x FROM (SELECT user_id, item_id FROM z_train QUALIFY row_number() OVER (
         PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) = 1) n JOIN z_tok t USING (item_id)""",
)
cte(
    "z_beam_recs",
    f"""SELECT u.user_id, l.item_id, l.logp AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY l.rank) AS rank
       FROM z_user_x u JOIN z_beam_lists l USING (x)
       WHERE NOT EXISTS (SELECT 1 FROM z_seen s WHERE s.user_id = u.user_id AND s.item_id = l.item_id)
       QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY l.rank) <= {BEAM}""",
)

# Ranking features.
cte("z_val_targets", "SELECT user_id, item_id FROM z_targets WHERE split = 'val'")
cte("z_val_cands", "SELECT * FROM z_cands WHERE user_id IN (SELECT user_id FROM z_val_targets)")
cte(
    "z_train_stats",
    """SELECT min(us) AS lo, greatest(max(us) - min(us), 1) AS span, avg(us) AS mean, median(unit_price) AS price FROM z_train""",
)
cte(
    "z_item_feats",
    """SELECT c.item_id, ln(1.0::DOUBLE + coalesce(n, 0)) AS item_popularity_log, coalesce(p, s.price) AS item_price_imputed,
       CASE WHEN p IS NULL THEN 0 ELSE 1 END AS has_price, (coalesce(t.mean, s.mean) - s.lo) / s.span AS item_recency_norm
       FROM z_catalog c LEFT JOIN (SELECT item_id, count(*) AS n, median(unit_price) AS p, avg(us) AS mean FROM z_train GROUP BY item_id) t
         USING (item_id) CROSS JOIN z_train_stats s""",
)
cte(
    "z_profile",
    """SELECT user_id, list(m ORDER BY i) AS p FROM (SELECT user_id, i, avg(x) AS m FROM (
         SELECT t.user_id, unnest(range(64)) AS i, unnest(e.v) AS x FROM z_train t JOIN z_emb e USING (item_id)) GROUP BY user_id, i)
       GROUP BY user_id""",
)
cte(
    "z_features",
    """SELECT c.user_id, c.item_id, c.rank, c.score AS als_score, f.item_popularity_log, f.item_price_imputed, f.has_price,
       f.item_recency_norm, coalesce(list_dot_product(e.v, p.p) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(p.p, p.p)), 0.0) AS content_sim,
       ln(1.0::DOUBLE + coalesce(h.n, 0)) AS user_n_interactions_log
       FROM z_val_cands c JOIN z_item_feats f USING (item_id) JOIN z_emb e USING (item_id) LEFT JOIN z_profile p ON p.user_id = c.user_id
       LEFT JOIN (SELECT user_id, count(*) AS n FROM z_train GROUP BY user_id) h ON h.user_id = c.user_id""",
)
cte(
    "z_labelled",
    """SELECT f.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS label FROM z_features f LEFT JOIN z_val_targets t
       ON t.user_id = f.user_id AND t.item_id = f.item_id""",
)
