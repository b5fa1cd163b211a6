"""Content vectors, neighbours, semantic ids and tokens."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.text import ENGLISH_STOP_WORDS, WORD_PATTERN
from reckoner.functions.vectors import as_doubles
from reckoner.operators import embeddings as emb, semantic_ids as sid, splitting, tokens as tok
from reckoner.operators.dotscore import cosine_topk, hashed_cosine_topk
from reckoner.operators.ordering import durable, scratch_path
from reckoner.operators.popularity import popularity
from reckoner.plans.registry import presented, query
from reckoner.plans.sequence_queries import train_in, train_of
from reckoner.sources import writers
from reckoner.sources.fixtures import Fixtures

LEVELS = 3
SVD_DIMS = 128
CODES = 256

STOPS_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
TFIDF_SQL = f"""WITH tokens AS (
      SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD_PATTERN}'), lambda w: NOT list_contains([{STOPS_SQL}], w)) AS t FROM documents),
    terms AS (SELECT doc_id, unnest(t) AS term FROM tokens
      UNION ALL SELECT doc_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda z: z[1] || ' ' || z[2])) FROM tokens WHERE len(t) > 1),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 20000),
    weighted AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0) AS w
      FROM counts JOIN vocab USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""


def weights_of(fx: Fixtures) -> DataFrame:
    return emb.tfidf(fx.table("documents"), "doc_id", "text", partitions=fx.spark.sparkContext.defaultParallelism)


@query("emb_01_tfidf", TFIDF_SQL)
def emb_01(fx: Fixtures) -> DataFrame:
    return presented(weights_of(fx))


@query("emb_02_truncated_svd")
def emb_02(fx: Fixtures) -> DataFrame:
    projected, explained = emb.truncated_svd(durable(weights_of(fx)), "doc_id", SVD_DIMS, fx.table("documents"))
    return presented(projected.withColumn("explained", F.lit(explained)))


@query(
    "emb_03_l2_normalise",
    """SELECT vec_id, i AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value
       FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM z_vec)""",
)
def emb_03(fx: Fixtures) -> DataFrame:
    unit = emb.l2_normalised(fx.table("embeddings"))
    return presented(unit.select("vec_id", F.posexplode("embedding").alias("dim", "value")))


@query("emb_04_encode_text")
def emb_04(fx: Fixtures) -> DataFrame:
    return presented(emb.encode_text(fx.table("documents"), "doc_id", "text", emb.hashing_encoder(64)))


@query(
    "emb_05_cosine_neighbours",
    """SELECT a.vec_id AS query_id, b.vec_id AS item_id,
       round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS score,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v)
         / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) DESC, b.vec_id) AS rank
       FROM z_vec a JOIN z_vec b ON a.vec_id <> b.vec_id QUALIFY rank <= 10""",
)
def emb_05(fx: Fixtures) -> DataFrame:
    vectors = fx.table("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return presented(cosine_topk(vectors, vectors, 10))


@query("emb_05_hashed_neighbours")
def emb_05_hashed(fx: Fixtures) -> DataFrame:
    vectors = fx.table("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return presented(hashed_cosine_topk(vectors, vectors, 10))


STANDARD_SQL = """SELECT item_id, i - 1 AS dim, round((x - m) / (s + 1e-8::DOUBLE), 6) AS value
    FROM (SELECT item_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM z_emb) JOIN z_std_long USING (i)"""


@query("emb_06_standardise", STANDARD_SQL)
def emb_06(fx: Fixtures) -> DataFrame:
    scaled, _ = emb.standardise(fx.item_embeddings())
    return presented(scaled.select("item_id", F.posexplode("embedding").alias("dim", "value")))


@query(
    "emb_06_statistics",
    "SELECT i - 1 AS dim, round(m, 6) AS mean, round(s, 6) AS std FROM z_std_long",
)
def emb_06_stats(fx: Fixtures) -> DataFrame:
    stats = emb.standardisation_stats(fx.item_embeddings())
    long = stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "e"))
    return presented(long.select("dim", "e.mean", "e.std"))


@query(
    "emb_07_mean_pairwise_cosine",
    """WITH u AS (SELECT unnest(range(64)) AS i, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM z_vec),
       n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM z_vec)
       SELECT CAST(any_value(n.n) AS BIGINT) AS n_vectors, round((sum(s * s) - any_value(n.n)) / (any_value(n.n) * (any_value(n.n) - 1)), 6) AS mean_cosine
       FROM (SELECT i, sum(x) AS s FROM u GROUP BY i) CROSS JOIN n""",
)
def emb_07(fx: Fixtures) -> DataFrame:
    return presented(emb.mean_pairwise_cosine(fx.table("embeddings")))


@query("emb_09_saved_statistics", STANDARD_SQL)
def emb_09(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "stats")
    writers.write_stage(emb.standardisation_stats(fx.item_embeddings()), path)
    scaled = emb.apply_standardisation(fx.item_embeddings(), fx.spark.read.parquet(path))
    return presented(scaled.select("item_id", F.posexplode("embedding").alias("dim", "value")))


@query(
    "emb_10_row_cosines",
    """SELECT e.item_id, round(list_dot_product(e.v, w) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(w, w)), 6) AS cosine
       FROM (SELECT item_id, v, list_transform(list_zip(v, s.m), lambda z: z[1] - z[2]) AS w FROM z_emb CROSS JOIN z_std s) e""",
)
def emb_10(fx: Fixtures) -> DataFrame:
    live = fx.item_embeddings()
    stats = emb.standardisation_stats(live)
    centred = live.withColumn("_m", stats.select("mean").scalar()).select(
        "item_id", F.zip_with(as_doubles(F.col("embedding")), "_m", lambda x, m: x - m).alias("embedding")
    )
    return presented(emb.row_cosines(live, centred))


def codebooks_of(fx: Fixtures, vectors: DataFrame | None = None) -> DataFrame:
    """Codebooks of group means over all vectors: by label, and by 16 and 8 ranges of the vector id."""
    vectors = fx.table("embeddings") if vectors is None else vectors
    vectors = vectors.select("vec_id", "label", array_to_vector(as_doubles(F.col("embedding"))).alias("v"))
    n = vectors.agg(F.count("*").alias("n")).scalar()
    groups = F.array(
        F.struct(F.lit(1).alias("level"), F.col("label").cast("int").alias("code")),
        F.struct(F.lit(2).alias("level"), F.floor(F.col("vec_id") * 16 / n).cast("int").alias("code")),
        F.struct(F.lit(3).alias("level"), F.floor(F.col("vec_id") * 8 / n).cast("int").alias("code")),
    )
    long = vectors.select(F.explode(groups).alias("g"), "v").select("g.level", "g.code", "v")
    return long.groupBy("level", "code").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def quantised_of(fx: Fixtures) -> DataFrame:
    return sid.quantise(fx.item_embeddings(), codebooks_of(fx))


def sids_of(fx: Fixtures) -> DataFrame:
    return sid.semantic_ids(quantised_of(fx), LEVELS)


def numbered_of(fx: Fixtures) -> DataFrame:
    return sid.add_dedup_digit(sids_of(fx))


def tokens_of(fx: Fixtures) -> tuple[DataFrame, tok.Vocabulary]:
    ids = numbered_of(fx)
    vocabulary = tok.vocabulary_for(ids, user_buckets=2000)
    return tok.item_tokens(ids, vocabulary), vocabulary


@query("sid_01_fit_codebooks")
def sid_01(fx: Fixtures) -> DataFrame:
    scaled, _ = emb.standardise(fx.item_embeddings())
    return presented(sid.fit_residual_codebooks(scaled, levels=LEVELS, k=CODES, iters=15))


def fitted_tokens_of(fx: Fixtures) -> DataFrame:
    """Item tokens of the whole chain: standardised vectors, fitted codebooks, codes, dedup digit, tokens."""
    scaled = durable(emb.standardise(fx.item_embeddings())[0])
    books = durable(sid.fit_residual_codebooks(scaled, levels=LEVELS, k=CODES, iters=15))
    ids = durable(sid.add_dedup_digit(sid.semantic_ids(sid.quantise(scaled, books), LEVELS)))
    return durable(tok.item_tokens(ids, tok.vocabulary_for(ids, user_buckets=2000)))


SID_02_SQL = """SELECT item_id, concat_ws(' ', c1, c2, c3) AS codes,
    concat_ws(' ', printf('%.6f', round(d1, 6)), printf('%.6f', round(d2, 6)), printf('%.6f', round(d3, 6))) AS distances FROM z_sid"""


@query("sid_02_quantise", SID_02_SQL)
def sid_02(fx: Fixtures) -> DataFrame:
    return presented(quantised_of(fx))


@query("sid_02_quantise_expression", SID_02_SQL)
def sid_02_expression(fx: Fixtures) -> DataFrame:
    return presented(sid.quantise_expression(fx.item_embeddings(), codebooks_of(fx), LEVELS))


@query(
    "sid_03_reconstruction",
    "SELECT count(*) AS n_items, round(avg(list_dot_product(r, r) / 64), 6) AS mse FROM z_sid",
)
def sid_03(fx: Fixtures) -> DataFrame:
    rebuilt = sid.reconstruct(quantised_of(fx), codebooks_of(fx), LEVELS)
    return presented(sid.reconstruction_error(fx.item_embeddings(), rebuilt))


@query(
    "sid_04_level_errors",
    """SELECT 1::BIGINT AS level, round(avg(d1), 6) AS mean_distance FROM z_sid UNION ALL SELECT 2, round(avg(d2), 6) FROM z_sid
       UNION ALL SELECT 3, round(avg(d3), 6) FROM z_sid""",
)
def sid_04(fx: Fixtures) -> DataFrame:
    return presented(sid.level_errors(quantised_of(fx)))


@query(
    "sid_05_collisions",
    """SELECT count(*) AS n_tuples, CAST(sum(n) AS BIGINT) AS n_items, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_sharing,
       round(100.0::DOUBLE * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS pct_sharing, max(n) AS largest_group
       FROM (SELECT c1, c2, c3, count(*) AS n FROM z_sid GROUP BY ALL)""",
)
def sid_05(fx: Fixtures) -> DataFrame:
    return presented(sid.collision_report(sids_of(fx)))


@query("sid_06_dedup_digit", "SELECT item_id, c1 AS sid_level_1, c2 AS sid_level_2, c3 AS sid_level_3, dedup AS sid_dedup FROM z_sid")
def sid_06(fx: Fixtures) -> DataFrame:
    ids = numbered_of(fx)
    sid.assert_unique(ids)
    return presented(ids)


@query(
    "sid_07_utilisation",
    """SELECT b.level::BIGINT AS level, u.used, b.codes, round(CAST(u.used AS DOUBLE) / b.codes, 6) AS share
       FROM (SELECT level, count(*) AS codes FROM z_book GROUP BY level) b JOIN (
         SELECT 1 AS level, count(DISTINCT c1) AS used FROM z_sid UNION ALL SELECT 2, count(DISTINCT c2) FROM z_sid
         UNION ALL SELECT 3, count(DISTINCT c3) FROM z_sid) u USING (level)""",
)
def sid_07(fx: Fixtures) -> DataFrame:
    return presented(sid.utilisation(sids_of(fx), codebooks_of(fx)))


@query(
    "sid_08_prefix_relatives",
    """SELECT q.item_id AS query_id, s.item_id FROM z_sid q JOIN z_sid s ON s.c1 = q.c1 AND s.c2 = q.c2 AND s.item_id <> q.item_id
       WHERE q.item_id = (SELECT item_id FROM z_pop WHERE rank = 1)""",
)
def sid_08(fx: Fixtures) -> DataFrame:
    query_item = popularity(train_of(fx)).where(F.col("rank") == 1)
    return sid.prefix_relatives(sids_of(fx), query_item, 2)


@query(
    "sid_08_largest_family",
    "SELECT c1 AS sid_level_1, count(*) AS n_items FROM z_sid GROUP BY c1 ORDER BY n_items DESC, c1 LIMIT 1",
)
def sid_08_family(fx: Fixtures) -> DataFrame:
    return presented(sid.largest_family(sids_of(fx)))


@query(
    "sid_08_colliding_members",
    """SELECT * FROM (SELECT item_id, c1 AS sid_level_1, c2 AS sid_level_2, c3 AS sid_level_3, count(*) OVER (PARTITION BY c1, c2, c3) AS n
       FROM z_sid) WHERE n > 1""",
)
def sid_08_members(fx: Fixtures) -> DataFrame:
    return presented(sid.colliding_members(sids_of(fx)))


def item_spans(fx: Fixtures) -> DataFrame:
    """First and last interaction of every item, two rows each: the time span of all rows, and an item has rows before a time
    if and only if its first is. One aggregation, staged: the joins behind it run once, with these two columns only."""
    ends = F.array(F.min("ts"), F.max("ts")).alias("ends")
    spans = durable(fx.interactions().select("item_id", "ts").groupBy("item_id").agg(ends))
    return spans.select("item_id", F.explode("ends").alias("ts"))


@query(
    "sid_09_cold_items",
    """WITH warm AS (SELECT DISTINCT item_id FROM z_train),
       ids AS (SELECT s.item_id, c1, c2, c3, w.item_id IS NOT NULL AS known,
         row_number() OVER (PARTITION BY c1, c2, c3, w.item_id IS NOT NULL ORDER BY s.item_id) - 1 AS pos,
         count(w.item_id) OVER (PARTITION BY c1, c2, c3) AS n_known FROM z_item_vec s JOIN z_q_three_scaled USING (vec_id)
         LEFT JOIN warm w USING (item_id))
       SELECT item_id, c1 AS sid_level_1, c2 AS sid_level_2, c3 AS sid_level_3, pos + n_known AS sid_dedup FROM ids WHERE NOT known""",
)
def sid_09(fx: Fixtures) -> DataFrame:
    known = train_in(splitting.time_split(item_spans(fx))).select("item_id").distinct()
    marked = fx.item_ids().join(known.withColumn("_known", F.lit(True)), "item_id", "left")
    vectors = durable(fx.item_embeddings(marked))  # marked before the vectors come in, which are not shuffled by item then
    warm = vectors.where("_known").drop("_known")
    stats = durable(emb.standardisation_stats(warm))
    books = durable(codebooks_of(fx, emb.apply_standardisation(fx.table("embeddings"), stats)))
    taken = sid.add_dedup_digit(sid.semantic_ids(sid.quantise(emb.apply_standardisation(warm, stats), books), LEVELS))
    path = scratch_path(fx.spark, "chain")
    writers.save_tables({"statistics": stats, "codebooks": books, "taken": taken}, path)
    saved = writers.load_tables(fx.spark, path, ["statistics", "codebooks", "taken"])
    cold = vectors.where("_known is null").drop("_known")
    return presented(sid.cold_item_ids(cold, saved["statistics"], saved["codebooks"], LEVELS, saved["taken"]))


@query("tok_01_item_tokens", "SELECT item_id, tok1, tok2, tok3, tok4 FROM z_tok")
def tok_01(fx: Fixtures) -> DataFrame:
    return presented(tokens_of(fx)[0])


ITEM_VOCAB_SQL = "(SELECT 768 + max(dedup) + 1 FROM z_sid)"


@query(
    "tok_02_user_bucket",
    f"SELECT DISTINCT user_id, {ITEM_VOCAB_SQL} + user_id % 2000 AS token FROM z_inter",
)
def tok_02(fx: Fixtures) -> DataFrame:
    _, vocabulary = tokens_of(fx)
    users = fx.interactions().select("user_id").distinct()
    return presented(users.withColumn("token", tok.user_bucket_token(F.col("user_id"), vocabulary)))


def _stream_sql(n: int, rows: str = "z_train") -> str:
    return f"""SELECT user_id, list_concat([{ITEM_VOCAB_SQL} + user_id % 2000], flatten(list([tok1, tok2, tok3, tok4] ORDER BY us, k1, k2, item_id))) AS t
        FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) <= {n})
        JOIN z_tok USING (item_id) GROUP BY user_id"""


@query(
    "tok_03_token_streams",
    f"""SELECT user_id, array_to_string(list_concat(t, list_transform(range(41 - len(t)), lambda i: {ITEM_VOCAB_SQL} + 2000)), ' ') AS tokens,
        CAST(len(t) AS BIGINT) AS length FROM ({_stream_sql(10)})""".replace(
        f"lambda i: {ITEM_VOCAB_SQL} + 2000", "lambda i: pad"
    ).replace(f"FROM ({_stream_sql(10)})", f"FROM ({_stream_sql(10)}) CROSS JOIN (SELECT {ITEM_VOCAB_SQL} + 2000 AS pad)"),
)
def tok_03(fx: Fixtures) -> DataFrame:
    tokens, vocabulary = tokens_of(fx)
    return presented(tok.token_streams(train_of(fx), tokens, vocabulary))


@query(
    "tok_03_loo_token_streams",
    f"""SELECT user_id, array_to_string(list_concat(t, list_transform(range(41 - len(t)), lambda i: pad)), ' ') AS tokens,
        CAST(len(t) AS BIGINT) AS length FROM ({_stream_sql(10, "z_loo_train")}) CROSS JOIN (SELECT {ITEM_VOCAB_SQL} + 2000 AS pad)""",
)
def tok_03_loo(fx: Fixtures) -> DataFrame:
    """Streams of the leave-one-out protocol: first interactions of each user without the last two."""
    tokens, vocabulary = tokens_of(fx)
    train = splitting.loo_split(fx.interactions()).where(F.col("split") == "train")
    return presented(tok.token_streams(train, tokens, vocabulary))


@query(
    "tok_04_length_statistics",
    f"""SELECT min(len(t))::BIGINT AS min_len, round(median(len(t)), 6) AS median_len, round(avg(len(t)), 6) AS mean_len, max(len(t))::BIGINT AS max_len
        FROM ({_stream_sql(10)})""",
)
def tok_04(fx: Fixtures) -> DataFrame:
    tokens, vocabulary = tokens_of(fx)
    return presented(tok.length_statistics(tok.token_streams(train_of(fx), tokens, vocabulary)))


@query(
    "tok_05_decoding_contexts",
    f"SELECT user_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS length FROM ({_stream_sql(9)})",
)
def tok_05(fx: Fixtures) -> DataFrame:
    tokens, vocabulary = tokens_of(fx)
    return presented(tok.decoding_contexts(train_of(fx), tokens, vocabulary))


@query(
    "tok_06_prefix_table",
    "SELECT depth::BIGINT AS depth, array_to_string(prefix, '-') AS prefix, token, n_items, item_id FROM z_children",
)
def tok_06(fx: Fixtures) -> DataFrame:
    return presented(tok.prefix_table(tokens_of(fx)[0], LEVELS + 1))


@query(
    "snk_04_token_stage",
    f"""SELECT (SELECT count(*) FROM z_tok) AS n_items, (SELECT count(DISTINCT user_id) FROM z_train) AS n_users,
        {ITEM_VOCAB_SQL} + 2000 AS pad""",
)
def snk_04(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "tokens")
    tokens, vocabulary = tokens_of(fx)
    streams = tok.token_streams(train_of(fx), tokens, vocabulary)
    writers.write_token_stage(streams, tokens, tok.vocabulary_table(fx.spark, vocabulary), path)
    read = fx.spark.read.parquet
    meta = read(f"{path}/vocabulary").select("pad")
    n_items = read(f"{path}/item_tokens").agg(F.count("*").alias("n"))
    n_users = read(f"{path}/streams").agg(F.count("*").alias("n"))
    return presented(meta.withColumns({"n_items": n_items.scalar(), "n_users": n_users.scalar()}))
