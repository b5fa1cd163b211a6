"""Sources, cleaning and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import parse_price
from reckoner.operators import cleaning, dimensions, sequences, splitting
from reckoner.operators.ordering import durable, scratch_path
from reckoner.plans.registry import presented, query
from reckoner.plans.sequence_queries import TARGET_PARTS_SQL, TRAIN_PARTS_SQL
from reckoner.sources import readers, writers
from reckoner.sources.fixtures import Fixtures


@query("src_01_read_ratings", 'SELECT user_id, parent_asin, rating, "timestamp" FROM z_ratings')
def src_01(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "ratings")
    rows = fx.raw_ratings().select("user_id", "parent_asin", "rating", "timestamp")
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return presented(readers.read_ratings(fx.spark, path, partitions=fx.spark.sparkContext.defaultParallelism))


@query(
    "src_01_row_order",
    """SELECT user_id, parent_asin, rating, "timestamp",
       row_number() OVER (ORDER BY user_id NULLS FIRST, parent_asin, "timestamp", rating) - 1 AS row_order FROM z_ratings""",
)
def src_01_row_order(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "ratings")
    order = ["user_id", "parent_asin", "timestamp", "rating"]
    rows = fx.raw_ratings().select("user_id", "parent_asin", "rating", "timestamp")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return presented(readers.staged_in_file_order(readers.read_ratings(fx.spark, path)).drop("source_file", "row_in_file"))


def _metadata_files(fx: Fixtures) -> str:
    path = scratch_path(fx.spark, "meta")
    fx.raw_meta().write.option("compression", "gzip").json(path)
    return path


@query(
    "src_02_read_metadata",
    """SELECT parent_asin, title, price, CAST(NULL AS VARCHAR) AS store, categories,
       CASE WHEN features = '' THEN NULL ELSE features END AS features FROM z_meta""",
)
def src_02(fx: Fixtures) -> DataFrame:
    df = readers.read_metadata(fx.spark, _metadata_files(fx))
    return presented(df.select("parent_asin", "title", "price", "store", "categories", "features"))


@query(
    "src_03_flatten_text_arrays",
    "SELECT parent_asin, categories, features, '' AS description FROM z_meta",
)
def src_03(fx: Fixtures) -> DataFrame:
    df = readers.read_metadata(fx.spark, _metadata_files(fx))
    flat = readers.flatten_text_arrays(df, ["categories", "features", "description"])
    return flat.select("parent_asin", "categories", "features", "description")


@query(
    "src_04_read_retail",
    """SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description, Quantity AS quantity,
       epoch_us(InvoiceDate) AS invoice_us, UnitPrice AS unit_price, CAST(CustomerID AS VARCHAR) AS customer_id FROM z_retail""",
)
def src_04(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "retail")
    fx.raw_retail().write.option("header", True).csv(path)
    df = readers.read_retail(fx.spark, path)
    return presented(
        df.select(
            F.col("InvoiceNo").alias("invoice_no"),
            F.col("StockCode").alias("stock_code"),
            F.col("Description").alias("description"),
            F.col("Quantity").alias("quantity"),
            F.unix_micros(F.col("InvoiceDate").cast("timestamp")).alias("invoice_us"),
            F.col("UnitPrice").alias("unit_price"),
            F.col("CustomerID").alias("customer_id"),
        )
    )


@query(
    "src_05_stage_round_trip",
    "SELECT split, count(*) AS n_rows, sum(quantity) AS quantity, sum(item_id) AS item_sum FROM z_split GROUP BY split",
)
def src_05(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "splits")
    writers.write_stage(splitting.time_split(fx.interactions()), path, ["split"])
    stage = readers.read_stage(fx.spark, path)
    return presented(
        stage.groupBy("split").agg(
            F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity"), F.sum("item_id").alias("item_sum")
        )
    )


@query(
    "src_06_embeddings_by_key",
    "SELECT item_id, round(v[1], 6) AS first_value, CAST(len(v) AS BIGINT) AS dims FROM z_emb",
)
def src_06(fx: Fixtures) -> DataFrame:
    df = readers.embeddings_for(fx.catalog().select("item_id"), fx.item_embeddings())
    return presented(
        df.select("item_id", F.get("embedding", F.lit(0)).alias("first_value"), F.size("embedding").alias("dims"))
    )


@query("src_07_load_targets", "SELECT split, user_id, item_id FROM z_targets WHERE split = 'val'")
def src_07(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "targets")
    val = splitting.time_split(fx.interactions()).where(F.col("split") == "val")
    writers.write_stage(sequences.target_sets(val), path)
    return readers.long_targets(readers.read_stage(fx.spark, path)).withColumn("split", F.lit("val"))


@query(
    "src_08_load_sequences",
    f"""SELECT user_id, part, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY us, k1, k2, item_id) AS item_ids
       FROM ({TRAIN_PARTS_SQL}) GROUP BY user_id, part""",
)
def src_08(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "sequences")
    train = splitting.time_split(fx.interactions()).where(F.col("split") == "train")
    writers.write_stage(sequences.user_sequences(train), path)
    return presented(readers.read_stage(fx.spark, path).select("user_id", "part", "item_ids"))


@query(
    "snk_01_export_csv",
    f"""SELECT user_id, part, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS item_ids
       FROM ({TARGET_PARTS_SQL.format(split="val")}) GROUP BY user_id, part""",
)
def snk_01(fx: Fixtures) -> DataFrame:
    stage, out = scratch_path(fx.spark, "stage"), scratch_path(fx.spark, "csv")
    val = splitting.time_split(fx.interactions()).where(F.col("split") == "val")
    writers.write_stage(sequences.target_sets(val), f"{stage}/val_targets")
    tables = {"val_targets": f"{stage}/val_targets", "absent": f"{stage}/absent"}
    writers.export_csv(fx.spark, tables, out)
    back = fx.spark.read.option("header", True).csv(f"{out}/val_targets")
    return back.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "part")], "item_ids")


@query(
    "snk_02_stats_json",
    """SELECT (SELECT count(DISTINCT user_id) FROM z_loo) AS n_users,
       (SELECT count(*) FROM z_loo WHERE split = 'train') AS train_rows""",
)
def snk_02(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "stats")
    writers.write_stats_json(splitting.loo_stats(splitting.loo_split(fx.interactions())), path)
    return fx.spark.read.json(path).select("n_users", "train_rows")


@query(
    "snk_03_merge_results",
    """SELECT split, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM z_split WHERE split <> 'test' GROUP BY split
       UNION ALL SELECT 'test', 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM z_split WHERE split = 'test'""",
)
def snk_03(fx: Fixtures) -> DataFrame:
    split = splitting.time_split(fx.interactions())
    path = scratch_path(fx.spark, "results")

    def tidy(df: DataFrame, metric: str, value) -> DataFrame:
        grouped = df.groupBy("split").agg(value.cast("double").alias("value"), F.count_distinct("user_id").alias("n_users"))
        return grouped.select(
            "split", F.lit("data").alias("model"), F.lit(metric).alias("metric"), F.lit(0).alias("k"), "value", "n_users"
        )

    writers.save_results(tidy(split, "rows", F.count("*")), path)
    writers.save_results(tidy(split.where(F.col("split") == "test"), "users", F.count_distinct("user_id")), path)
    return presented(writers.load_results(fx.spark, path).select("split", "metric", "value"))


@query(
    "cln_01_clean_retail",
    """SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, Quantity AS quantity, CustomerID AS customer_id,
       epoch_us(InvoiceDate) AS invoice_us FROM z_retail_clean""",
)
def cln_01(fx: Fixtures) -> DataFrame:
    clean = cleaning.clean_retail(fx.raw_retail())
    return presented(
        clean.select(
            F.col("InvoiceNo").alias("invoice_no"),
            F.col("StockCode").alias("stock_code"),
            F.col("Quantity").alias("quantity"),
            F.col("CustomerID").alias("customer_id"),
            F.col("InvoiceDate").alias("invoice_us"),
        )
    )


@query(
    "cln_02_share_kept",
    """SELECT (SELECT count(*) FROM z_retail) AS rows_in, (SELECT count(*) FROM z_retail_clean) AS rows_kept,
       round(CAST((SELECT count(*) FROM z_retail_clean) AS DOUBLE) / (SELECT count(*) FROM z_retail), 6) AS share_kept""",
)
def cln_02(fx: Fixtures) -> DataFrame:
    return presented(cleaning.share_kept(fx.raw_retail(), cleaning.retail_row_is_valid()))


@query("cln_03_clean_ratings", 'SELECT user_id, parent_asin, "timestamp", rating, k1, k2 FROM z_ratings_clean')
def cln_03(fx: Fixtures) -> DataFrame:
    return presented(cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"]))


@query("cln_04_epoch_millis", 'SELECT user_id, parent_asin, "timestamp" * 1000 AS ts FROM z_ratings')
def cln_04(fx: Fixtures) -> DataFrame:
    return presented(cleaning.with_timestamp(fx.raw_ratings()).select("user_id", "parent_asin", "ts"))


@query(
    "cln_05_parse_price",
    r"""SELECT parent_asin, round(try_cast(replace(regexp_extract(price, '[\d,]+\.?\d*'), ',', '') AS DOUBLE), 6) AS price
        FROM z_meta""",
)
def cln_05(fx: Fixtures) -> DataFrame:
    return presented(fx.raw_meta().select("parent_asin", parse_price(F.col("price")).alias("price")))


@query(
    "cln_06_derived_constants",
    """SELECT user_id, parent_asin, 1::BIGINT AS quantity,
       'r' || concat_ws('-', CAST(k1 AS VARCHAR), CAST(k2 AS VARCHAR), parent_asin) AS invoice_id FROM z_ratings_clean""",
)
def cln_06(fx: Fixtures) -> DataFrame:
    label = F.concat_ws("-", F.col("k1").cast("string"), F.col("k2").cast("string"), "parent_asin")
    df = cleaning.with_derived_constants(cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"]), label)
    return presented(df.select("user_id", "parent_asin", "quantity", "invoice_id"))


@query(
    "cln_07_fill_titles",
    "SELECT parent_asin, coalesce(title, 'UNKNOWN') AS title, coalesce(title, '') AS embedding_input FROM z_meta",
)
def cln_07(fx: Fixtures) -> DataFrame:
    meta = fx.raw_meta().select("parent_asin", "title").withColumn("embedding_input", F.col("title"))
    return cleaning.fill_titles(cleaning.fill_titles(meta, "title"), "embedding_input", "")


@query(
    "cln_08_ordered_layout",
    "SELECT user_id, item_id, invoice_id, quantity, round(unit_price, 6) AS unit_price, us AS ts, k1, k2 FROM z_inter",
)
def cln_08(fx: Fixtures) -> DataFrame:
    return presented(cleaning.ordered_layout(fx.interactions()))


@query("cln_09_search_titles", "SELECT item_id, description FROM z_catalog WHERE contains(lower(description), 'small')")
def cln_09(fx: Fixtures) -> DataFrame:
    return cleaning.search_titles(fx.catalog(), "SMALL").select("item_id", "description")


@query(
    "cln_10_count_between",
    "SELECT user_id, count(*) AS n FROM z_inter GROUP BY user_id HAVING count(*) BETWEEN 8 AND 25",
)
def cln_10(fx: Fixtures) -> DataFrame:
    return presented(cleaning.users_with_count_between(fx.interactions(), 8, 25))


@query(
    "cln_11_keyword_users",
    """SELECT user_id FROM (SELECT user_id, item_id FROM z_inter
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, k1 DESC, k2 DESC, item_id DESC) <= 2) t
       JOIN z_catalog c USING (item_id) GROUP BY user_id HAVING count_if(contains(lower(description), 'brand#1')) = 2""",
)
def cln_11(fx: Fixtures) -> DataFrame:
    return cleaning.keyword_users(fx.interactions(), fx.catalog(), "Brand#1", min_items=2)


@query(
    "cln_12_summary",
    "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM z_inter",
)
def cln_12(fx: Fixtures) -> DataFrame:
    return presented(cleaning.summary(fx.interactions()))


CANONICAL_SQL = """SELECT StockCode AS stock_code, coalesce(arg_min(Description, ord) FILTER (WHERE Description IS NOT NULL), 'UNKNOWN')
    AS description FROM (SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY n DESC, Description)
    AS ord FROM (SELECT StockCode, Description, count(*) AS n FROM z_retail_clean GROUP BY ALL)) GROUP BY StockCode"""


@query("dim_01_canonical_description", CANONICAL_SQL)
def dim_01(fx: Fixtures) -> DataFrame:
    df = dimensions.canonical_value(cleaning.clean_retail(fx.raw_retail()), "StockCode", "Description")
    return df.select(F.col("StockCode").alias("stock_code"), F.col("Description").alias("description"))


@query(
    "dim_01_item_catalog",
    f"SELECT row_number() OVER (ORDER BY stock_code) - 1 AS item_id, stock_code, description FROM ({CANONICAL_SQL})",
)
def dim_01_catalog(fx: Fixtures) -> DataFrame:
    return presented(dimensions.item_catalog(cleaning.clean_retail(fx.raw_retail())))


RATING_IDS_SQL = """SELECT {key} AS natural_key, row_number() OVER (ORDER BY {key}) - 1 AS dense_id
    FROM (SELECT DISTINCT {key} FROM z_ratings_clean)"""


@query("dim_02_dense_ids", RATING_IDS_SQL.format(key="user_id"))
def dim_02(fx: Fixtures) -> DataFrame:
    clean = cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"])
    ids = dimensions.dense_ids(clean, "user_id", "dense_id")
    return presented(ids.select(F.col("user_id").alias("natural_key"), "dense_id"))


@query(
    "dim_03_first_per_key",
    """SELECT parent_asin, "timestamp", rating, k1, k2, user_id FROM z_ratings_clean
       QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY "timestamp", k1, k2, user_id) = 1""",
)
def dim_03(fx: Fixtures) -> DataFrame:
    clean = cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"])
    return presented(dimensions.first_per_key(clean, "parent_asin", ["timestamp", "k1", "k2", "user_id"]))


@query(
    "dim_04_attach_lookup",
    r"""SELECT r.parent_asin, r.user_id, r."timestamp", coalesce(m.title, 'UNKNOWN') AS title,
        round(try_cast(replace(regexp_extract(m.price, '[\d,]+\.?\d*'), ',', '') AS DOUBLE), 6) AS price
        FROM z_ratings_clean r LEFT JOIN z_meta m USING (parent_asin)""",
)
def dim_04(fx: Fixtures) -> DataFrame:
    clean = cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"]).select("parent_asin", "user_id", "timestamp")
    meta = fx.raw_meta().select("parent_asin", "title", parse_price(F.col("price")).alias("price"))
    return presented(dimensions.attach_lookup(clean, meta, "parent_asin", {"title": "UNKNOWN"}))


@query(
    "dim_05_encode_ids",
    f"""SELECT u.dense_id AS user_id, i.dense_id AS item_id, r."timestamp", r.rating FROM z_ratings_clean r
        JOIN ({RATING_IDS_SQL.format(key="user_id")}) u ON u.natural_key = r.user_id
        JOIN ({RATING_IDS_SQL.format(key="parent_asin")}) i ON i.natural_key = r.parent_asin""",
)
def dim_05(fx: Fixtures) -> DataFrame:
    clean = durable(cleaning.clean_ratings(fx.raw_ratings(), ["k1", "k2"]))
    users = dimensions.user_catalog(clean, "user_id")
    items = dimensions.dense_ids(clean, "parent_asin", "item_id").withColumnRenamed("parent_asin", "stock_code")
    encoded = dimensions.encode_ids(clean, users, "user_id", items, "parent_asin")
    return presented(encoded.select("user_id", "item_id", "timestamp", "rating"))
