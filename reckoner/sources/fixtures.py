"""Recommender inputs over the star-schema test tables.

The tables have no late joiners, new products or missing prices of their own, so the views below derive
them from attributes. No row is dropped: customers that also appear in the event log and products larger
than size 40 keep all their rows, moved into the last 15% of the time span, so they are new to a model trained
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.functions.scalars import micros
from reckoner.operators.ordering import durable, owned_by
from reckoner.session import apply_runtime_conf

END_US = 1_004_832_000_000_000  # 2001-11-04 00:00:00 UTC, the last ship date
NO_PRICE_SIZE = 12
LATE_SIZE = 40
UNTITLED_SIZE = 50


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_runtime_conf(spark)
        self.folder = folder
        self._staged: tuple[object, DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sales(self, orders: DataFrame | None = None) -> DataFrame:
        orders = (self.table("orders") if orders is None else orders).withColumnRenamed("o_orderkey", "l_orderkey")
        part = self.table("part").withColumnRenamed("p_partkey", "l_partkey")
        return self.table("lineitem").join(orders, "l_orderkey").join(part, "l_partkey")

    def interactions(self) -> DataFrame:
        late_users = self.table("events").select(F.col("user_id").alias("o_custkey")).distinct()
        late_users = late_users.withColumn("_late", F.lit(True))
        # Joined to the orders, so that the many lines are not shuffled once more by user.
        sales = self._sales(self.table("orders").join(late_users, "o_custkey", "left"))
        us = micros(F.col("l_shipdate").cast("timestamp"))
        late = (F.col("p_size") > LATE_SIZE) | F.col("_late").isNotNull()
        shifted = F.lit(END_US) - F.expr(f"({END_US} - unix_micros(cast(l_shipdate as timestamp))) * 15 div 100")
        return sales.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_orderkey").cast("string").alias("invoice_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(F.col("p_size") > NO_PRICE_SIZE, F.col("p_retailprice")).alias("unit_price"),
            F.timestamp_micros(F.when(late, shifted).otherwise(us)).alias("ts"),
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").cast("long").alias("k2"),
        )

    def staged_interactions(self) -> DataFrame:
        """``interactions`` written once for all uses within one query, so that their joins run once."""
        owner = owned_by()
        if self._staged is None or self._staged[0] is not owner:
            self._staged = owner, durable(self.interactions())
        return self._staged[1]

    def raw_retail(self) -> DataFrame:
        invoice = F.col("l_orderkey").cast("string")
        cancelled = (F.col("o_orderstatus") == "F") & (F.col("l_linenumber") == 1)
        guest = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
        return self._sales().select(
            F.when(cancelled, F.concat(F.lit("C"), invoice)).otherwise(invoice).alias("InvoiceNo"),
            F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("StockCode"),
            F.when(F.col("p_size") == UNTITLED_SIZE, F.lit(None))
            .when(F.col("l_linenumber").isin(3, 6), F.upper("p_name"))
            .otherwise(F.col("p_name"))
            .alias("Description"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
            F.col("l_shipdate").cast("timestamp").alias("InvoiceDate"),
            F.col("p_retailprice").alias("UnitPrice"),
            F.when(~guest, F.col("o_custkey")).alias("CustomerID"),
            F.lit("XX").alias("Country"),
        )

    def raw_ratings(self) -> DataFrame:
        """Ratings with exact copies (quantity 50) and rows without a user (quantity 1)."""
        rows = self.interactions().select(
            F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("user_id"),
            F.concat(F.lit("B"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("parent_asin"),
            F.col("quantity").cast("double").alias("rating"),
            F.expr("unix_micros(ts) div 1000").alias("timestamp"),
            "k1",
            "k2",
        )
        copies = F.array(F.lit(0))
        copies = F.when(F.col("rating") == 50, F.array(F.lit(0), F.lit(100))).when(
            F.col("rating") == 1, F.array(F.lit(0), F.lit(200))
        ).otherwise(copies)
        return rows.withColumn("_copy", F.explode(copies)).select(
            F.when(F.col("_copy") != 200, F.col("user_id")).alias("user_id"),
            "parent_asin",
            "rating",
            "timestamp",
            "k1",
            (F.col("k2") + F.col("_copy")).alias("k2"),
        )

    def raw_meta(self) -> DataFrame:
        size = F.col("p_size")
        price = (
            F.when(size <= NO_PRICE_SIZE, F.lit(None))
            .when(size.isin(14, 21, 28, 35, 42, 49), F.concat(F.lit("from 1,"), size.cast("string"), F.lit("4.99")))
            .when(size.isin(22, 33, 44), F.lit("n/a"))
            .otherwise(F.col("p_retailprice").cast("string"))
        )
        title = F.when(size != UNTITLED_SIZE, F.concat_ws(" ", "p_brand", "p_type", "p_name"))
        asin = F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
        return self.table("part").select(
            asin.alias("parent_asin"),
            title.alias("title"),
            price.alias("price"),
            F.array("p_brand", "p_type").alias("categories"),
            F.when(size != UNTITLED_SIZE, F.split("p_name", " ")).alias("features"),
        )

    def catalog(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("stock_code"),
            F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("description"),
        )

    def item_ids(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"))

    def item_embeddings(self, items: DataFrame | None = None) -> DataFrame:
        """Every product with a vector; the vectors are reused, so products share them. ``items``: the products, with columns to keep."""
        vectors = self.table("embeddings").select("vec_id", "embedding")
        n = vectors.agg(F.count("*").alias("n"))
        items = self.item_ids() if items is None else items
        return items.withColumn("vec_id", F.pmod("item_id", n.scalar())).join(vectors, "vec_id").select(*items.columns, "embedding")

    def event_interactions(self) -> DataFrame:
        return (
            self.table("events")
            .where(F.col("event_type").isin("view", "purchase"))
            .select(
                "user_id",
                F.get_json_object("props", "$.k").cast("long").alias("item_id"),
                F.col("ts").cast("timestamp").alias("ts"),
                F.col("event_id").alias("k1"),
                F.lit(0).cast("long").alias("k2"),
            )
        )
