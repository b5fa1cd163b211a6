"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import line_dedup as lines
from reckoner.llm import cap_filters, collocations, maxscore, mixing, ngram_jaccard, packing, pii, quality_rules, spelling, substring_dedup, toxicity
from reckoner.llm import url_filter as urls
from reckoner.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.shared_passages(table(spark, folder, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op2_line_dedup",
    f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM split),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


def _url_sql() -> str:
    strict = ", ".join(f"('{t}', NULL)" for t in urls.STRICT_TERMS)
    soft = ", ".join(f"('{t}', {w})" for t, w in urls.SOFT_TERMS.items())
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
        for h, _, p, r in ((*rule.partition("/"), rule) for _, rule in sorted(urls.RULES, key=lambda x: -len(x[1])))
    )
    rules = ", ".join(f"('{r}', '{v}')" for v, r in urls.RULES)
    return f"""
WITH terms(term, weight) AS (VALUES {strict}, {soft}),
rules(rule, verdict) AS (VALUES {rules}),
pages_ AS (SELECT page_id, translate(coalesce(url, ''), {_AZ}) AS low, coalesce(url, '') AS url FROM pages),
rest_ AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages_),
parts AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest_),
hits AS (SELECT page_id, term, any_value(weight) AS weight FROM pages_, terms
         WHERE contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id, term),
counted AS (SELECT page_id, count(*) FILTER (weight IS NULL) AS strict_hits, count(weight) AS soft_hits,
                   coalesce(sum(weight), 0)::BIGINT AS soft_weight FROM hits GROUP BY page_id),
ruled AS (SELECT *, CASE {cases} END AS rule FROM parts)
SELECT r.page_id, host, path, r.rule,
       coalesce(rules.verdict, CASE WHEN coalesce(strict_hits, 0) > 0 OR (coalesce(soft_hits, 0) >= {urls.SOFT_DISTINCT} AND coalesce(soft_weight, 0) >= {urls.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_weight, 0) AS soft_weight
FROM ruled r LEFT JOIN counted USING (page_id) LEFT JOIN rules ON rules.rule = r.rule
"""


@query("op3_url_filter", _url_sql())
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_filter(table(spark, folder, "pages"))


@query(
    "op4_exact_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = maxscore.top_inner_products(table(spark, folder, "embeddings"), "_id % 50 = 0", 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query(
    "op5_source_mixing",
    """
WITH RECURSIVE sizes AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1)) AS size FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
terms(source, rate, k, p, cdf) AS (
    SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
    UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < rate + 10 * sqrt(rate) + 30),
drawn AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
copies AS (SELECT doc_id, any_value(d.source) AS source, count(*) FILTER (u >= cdf) AS n
           FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY doc_id),
each AS (SELECT doc_id, source, unnest(range(n)) AS copy FROM copies)
SELECT e.doc_id, e.source, e.copy::INTEGER AS copy, md5('17 order:' || e.doc_id || ':' || e.copy) AS order_key, md5(coalesce(text, '')) AS text_md5
FROM each e JOIN documents USING (doc_id)
""",
)
def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        "source",
        F.col("_copy").alias("copy"),
        F.col("_order").alias("order_key"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"),
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    predicted = (F.col("_score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_score").alias("score"), predicted)


@query("op7_embedding_near_dedup")
def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, folder, "embeddings"))


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_class").alias("class_id"), F.col("_links").alias("n_links"), F.col("_kept").alias("kept"))


@query("op9_pii_candidates")
def op9_pii_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("op10_hierarchical_packing")
def op10_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(TOKENIZER))


@query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality_rules.score(docs, quality_rules.train(docs, table(spark, folder, "labels")))
    predicted = (F.col("_score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", quality_rules.held_out().alias("held_out"), F.col("_score").alias("score"), predicted)


# The crc32 of a text's UTF-8 bytes: its 256 remainders are made by the rule, then the bytes fold over them.
_CRC_SQL = """
crc_table AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
                  lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
              FROM (SELECT unnest(range(256))::BIGINT AS i)),
"""


@query(
    "op12_spelling_variants",
    f"""
WITH RECURSIVE {_CRC_SQL}
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM held),
bytes_ AS (SELECT run, n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM coded),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
                  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM bytes_, crc_table),
struck AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM struck WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
firsts AS (SELECT p.word, n_near, top, min(near) AS form FROM pairs p JOIN best USING (word) WHERE near_n = top GROUP BY ALL),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN form END AS form,
                  CASE WHEN top >= 5 * n THEN top END AS form_n FROM words w LEFT JOIN firsts f USING (word)),
steps(word, root, step) AS (SELECT word, word, 0 FROM formed
                          UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word) r USING (word)
""",
)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, folder, "documents"), noise=199)
    return spelling.spelling_variants(words)


def _phrase_sql() -> str:
    words = {n: [f"lead(w, {i}) OVER p AS w{i}" for i in range(n)] for n in (1, 2, 3, 4)}
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS len, w{n - 1} IS NOT NULL AS full_, concat_ws(' ', {', '.join(f'w{i}' for i in range(n))}) AS phrase "
        f"FROM (SELECT lang, {', '.join(words[n])} FROM placed WINDOW p AS (PARTITION BY lang, row_, piece ORDER BY pos))"
        for n in (1, 2, 3, 4)
    )
    part = "array_to_string(string_split(phrase, ' ')[{}:{}], ' ')"
    return f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row_, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
pieces AS (SELECT lang, row_, unnest(p) AS t, unnest(range(len(p))) AS piece
           FROM (SELECT lang, row_, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS p FROM docs)),
placed AS (SELECT lang, row_, piece, unnest(w) AS w, unnest(range(len(w))) AS pos
           FROM (SELECT lang, row_, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
grams AS ({grams}),
f AS (SELECT lang, len, phrase, count(*) AS a FROM grams WHERE full_ GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, len, phrase, a, unnest(range(1, len)) AS k FROM f WHERE len > 1),
parted AS (SELECT *, {part.format("1", "k")} AS first_, {part.format("k + 1", "len")} AS rest_ FROM cuts),
scored AS (SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a)::HUGEINT)::BIGINT AS score FROM parted c
           JOIN f l ON l.lang = c.lang AND l.phrase = first_ AND l.len = k JOIN f r ON r.lang = c.lang AND r.phrase = rest_ AND r.len = c.len - k),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, {part.format("s", "s + m - 1")} AS phrase
           FROM (SELECT *, unnest(range(1, len - m + 2)) AS s FROM (SELECT *, unnest(range(2, len)) AS m FROM f WHERE len > 2))),
longer AS (SELECT lang, phrase, max(a) AS top FROM inner_ GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer o USING (lang, phrase) WHERE top IS NULL OR 100::HUGEINT * top < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", _phrase_sql())
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
