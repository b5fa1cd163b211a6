"""Readers for raw logs, catalogues and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions.scalars import flat_text
from reckoner.operators.ordering import at_least_partitions, durable
from reckoner.schemas import RAW_META, RAW_RATINGS, RETAIL_COLUMNS

ROWS_PER_FILE = 1_000_000


def read_ratings(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Gzip CSV with a header. A gzip file is one task, so the rows are spread right after reading."""
    df = spark.read.schema(RAW_RATINGS).option("header", True).csv(path)
    return at_least_partitions(df, partitions) if partitions else df


def staged_in_file_order(raw: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """A file reader's rows as a splittable staged table, with the place each row had in its file.

    Adds ``source_file``, ``row_in_file`` (from 0) and ``row_order``, the running number over all files in the order of their
    paths. Small files are packed into tasks by size, a compressed file that cannot be split is read once by one task as a
    stream, and either way the staged table is written in files of at most ``rows_per_file`` rows, so everything after
    it has even tasks. ``raw`` must come straight from a reader.
    """
    place = F.monotonically_increasing_id()
    marked = raw.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_mid"))
    rows = durable(marked, rows_per_file)
    # A block is read by one task from its first row to its last, so its numbers are consecutive. One row per block here.
    blocks = rows.groupBy("source_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    in_file = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("source_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "source_file",
        "_block",
        "_first",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_in_file"),
        F.coalesce(F.sum("_n").over(in_all), F.lit(0)).alias("_in_all"),
    )
    within = F.col("_mid") - F.col("_first")
    numbered = rows.join(blocks, ["source_file", "_block"])
    return numbered.select(
        *raw.columns, "source_file", (within + F.col("_in_file")).alias("row_in_file"), (within + F.col("_in_all")).alias("row_order")
    )


def read_metadata(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """JSON lines projected to the catalogue fields; a missing key is null."""
    wanted = set(columns) if columns is not None else None
    schema = T.StructType([f for f in RAW_META.fields if wanted is None or f.name in wanted])
    return spark.read.schema(schema).json(path)


def flatten_text_arrays(df: DataFrame, cols: list[str]) -> DataFrame:
    """List fields as one space-joined string, null as the empty string."""
    return df.withColumns({c: flat_text(F.col(c)) for c in cols})


def read_retail(spark: SparkSession, path: str) -> DataFrame:
    """Transactions CSV whose eight columns are named by position."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*RETAIL_COLUMNS)
    return df.withColumns({"Quantity": F.col("Quantity").cast("int"), "UnitPrice": F.col("UnitPrice").cast("double")})


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def embeddings_for(index: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of the indexed items, matched by key and never by row position."""
    return index.join(embeddings, "item_id").select("item_id", "embedding")


def long_targets(targets: DataFrame) -> DataFrame:
    """``(user_id, item_ids)`` as one row per pair."""
    return targets.select("user_id", F.explode("item_ids").alias("item_id"))
