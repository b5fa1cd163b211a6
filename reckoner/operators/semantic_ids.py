"""Semantic IDs: residual codebooks, quantisation, dedup digits and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.functions.vectors import as_doubles, plus, squared_distance
from reckoner.operators.embeddings import apply_standardisation
from reckoner.operators.ordering import durable, positions

CODEBOOK_SCHEMA = "level int, code int, centroid array<double>"
# Codebooks are broadcast. Levels x codes is a parameter, not data; this refuses a mistaken table.
MAX_CODE_VECTORS = 1 << 16


def codebook_arrays(codebooks: DataFrame) -> list[np.ndarray]:
    """Codebooks on the driver, one matrix per level in code order. Size-checked: L x K rows."""
    rows = codebooks.orderBy("level", "code").limit(MAX_CODE_VECTORS + 1).collect()
    if len(rows) > MAX_CODE_VECTORS:
        raise ValueError(f"more than {MAX_CODE_VECTORS} code vectors")
    levels: dict[int, list] = {}
    for r in rows:
        levels.setdefault(r["level"], []).append(r["centroid"])
    return [np.array(levels[level], dtype="float64") for level in sorted(levels)]


def nearest_codes(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid, lowest index on ties."""
    codes = np.empty(len(x), dtype="int64")
    dist = np.empty(len(x))
    step = max(1, (4 << 20) // centroids.size)
    for start in range(0, len(x), step):
        part = x[start : start + step]
        d = np.square(part[:, None, :] - centroids[None, :, :]).sum(axis=2)
        best = d.argmin(axis=1)
        codes[start : start + step] = best
        dist[start : start + step] = d[np.arange(len(part)), best]
    return codes, dist


def quantise(embeddings: DataFrame, codebooks: DataFrame, with_residual: bool = False) -> DataFrame:
    """``(item_id, codes, distances)``: nearest code per level, the residual carried to the next level.

    Arrow batches against broadcast codebooks; no shuffle.
    """
    levels = codebook_arrays(codebooks)
    shared = embeddings.sparkSession.sparkContext.broadcast(levels)

    def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        offsets = pa.array(np.arange(len(matrix) + 1, dtype="int32") * matrix.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            residual = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()
            codes = np.empty((batch.num_rows, len(shared.value)), dtype="int32")
            dist = np.empty(codes.shape)
            for level, centroids in enumerate(shared.value):
                codes[:, level], dist[:, level] = nearest_codes(residual, centroids)
                residual -= centroids[codes[:, level]]
            columns = [batch.column(0), lists(codes, pa.int32()), lists(dist, pa.float64())]
            names = ["item_id", "codes", "distances"]
            if with_residual:
                columns.append(lists(residual, pa.float64()))
                names.append("residual")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "item_id long, codes array<int>, distances array<double>" + (", residual array<double>" if with_residual else "")
    return embeddings.select(F.col("item_id").cast("long").alias("item_id"), as_doubles(F.col("embedding")).alias("v")).mapInArrow(run, schema)


def quantise_expression(embeddings: DataFrame, codebooks: DataFrame, levels: int) -> DataFrame:
    """The same codes with column expressions only (codebooks as scalar subqueries); used to check ``quantise``."""
    out = embeddings.select("item_id", as_doubles(F.col("embedding")).alias("_r"))
    picked = []
    for level in range(1, levels + 1):
        book = codebooks.where(F.col("level") == level).agg(
            F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("b")
        )
        out = out.withColumn("_book", book.scalar())
        nearest = F.array_min(
            F.transform("_book", lambda c: F.struct(squared_distance(F.col("_r"), c["centroid"]).alias("dist"), c["code"].alias("code")))
        )
        out = out.withColumn(f"_n{level}", nearest)
        chosen = F.get(F.filter("_book", lambda c: c["code"] == F.col(f"_n{level}.code")), F.lit(0))["centroid"]
        out = out.withColumn("_r", F.zip_with("_r", chosen, lambda x, c: x - c)).drop("_book")
        picked.append(f"_n{level}")
    return out.select(
        "item_id",
        F.array(*[F.col(f"{p}.code") for p in picked]).alias("codes"),
        F.array(*[F.col(f"{p}.dist") for p in picked]).alias("distances"),
    )


def fit_residual_codebooks(embeddings: DataFrame, levels: int = 3, k: int = 256, iters: int = 15, seed: int = 42) -> DataFrame:
    """Residual k-means: cluster, subtract the assigned centre, cluster the rest. Each level is a distributed job.

    Standardise the vectors first. Fewer distinct residuals than ``k`` give fewer codes. Centres are sorted, so a
    result always numbers its codes the same way.
    """
    spark = embeddings.sparkSession
    residual = embeddings.select("item_id", as_doubles(F.col("embedding")).alias("embedding"))
    rows: list[tuple[int, int, list[float]]] = []
    for level in range(1, levels + 1):
        points = residual.select(array_to_vector("embedding").alias("features")).persist()
        try:
            centres = KMeans(k=k, maxIter=iters, seed=seed + level, initMode="random").fit(points).clusterCenters()
        finally:
            points.unpersist()
        ordered = sorted({tuple(float(x) for x in c) for c in centres})
        book = [(level, code, list(c)) for code, c in enumerate(ordered)]
        rows += book
        if level < levels:
            one_level = spark.createDataFrame([(1, code, c) for _, code, c in book], CODEBOOK_SCHEMA)
            left = quantise(residual, one_level, with_residual=True)
            residual = durable(left.select("item_id", F.col("residual").alias("embedding")))
    return spark.createDataFrame(rows, CODEBOOK_SCHEMA)


def semantic_ids(quantised: DataFrame, levels: int) -> DataFrame:
    """``(item_id, sid_level_1..L)`` from the code lists."""
    return quantised.select("item_id", *[F.get("codes", F.lit(i)).alias(f"sid_level_{i + 1}") for i in range(levels)])


def level_columns(sids: DataFrame) -> list[str]:
    return sorted((c for c in sids.columns if c.startswith("sid_level_")), key=lambda c: int(c.rsplit("_", 1)[1]))


def reconstruct(quantised: DataFrame, codebooks: DataFrame, levels: int) -> DataFrame:
    """Sum of the chosen code vectors per item, with codebooks looked up as scalar subqueries."""
    out = quantised
    total = None
    for level in range(1, levels + 1):
        book = codebooks.where(F.col("level") == level).agg(
            F.map_from_entries(F.collect_list(F.struct("code", "centroid"))).alias("b")
        )
        out = out.withColumn(f"_b{level}", book.scalar())
        vector = F.element_at(F.col(f"_b{level}"), F.get("codes", F.lit(level - 1)))
        total = vector if total is None else plus(total, vector)
    return out.select("item_id", total.alias("reconstructed"))


def reconstruction_error(embeddings: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Mean squared error per vector element."""
    joined = embeddings.select("item_id", as_doubles(F.col("embedding")).alias("v")).join(rebuilt, "item_id")
    return joined.agg(
        F.count("*").alias("n_items"),
        F.avg(squared_distance(F.col("v"), F.col("reconstructed")) / F.size("v")).alias("mse"),
    )


def level_errors(quantised: DataFrame) -> DataFrame:
    """Mean squared distance between residual and chosen code per level."""
    long = quantised.select(F.posexplode("distances").alias("level", "dist"))
    return long.groupBy((F.col("level") + 1).alias("level")).agg(F.avg("dist").alias("mean_distance"))


def collision_report(sids: DataFrame) -> DataFrame:
    """Distinct code tuples, items that share one, and their percentage."""
    tuples = sids.groupBy(*level_columns(sids)).agg(F.count("*").alias("n"))
    shared = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return tuples.agg(
        F.count("*").alias("n_tuples"),
        F.sum("n").alias("n_items"),
        shared.alias("n_sharing"),
        F.try_divide(100.0 * shared, F.sum("n")).alias("pct_sharing"),
        F.max("n").alias("largest_group"),
    )


def add_dedup_digit(sids: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Running counter per code tuple in item order. A tuple shared by very many items stays distributed.

    With ``taken`` (already numbered ids) the counter starts after the digits in use.
    """
    keys = level_columns(sids)
    numbered = positions(sids, keys, [F.col("item_id")], "sid_dedup")
    if taken is not None:
        used = taken.groupBy(*keys).agg((F.max("sid_dedup") + 1).alias("_next"))
        numbered = numbered.join(used, keys, "left").withColumn("sid_dedup", F.col("sid_dedup") + F.coalesce("_next", F.lit(0)))
    return numbered.select("item_id", *keys, F.col("sid_dedup").cast("int").alias("sid_dedup"))


def assert_unique(sids: DataFrame) -> None:
    """Raise when two items share all digits."""
    clash = sids.groupBy(*level_columns(sids), "sid_dedup").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not clash.isEmpty():
        raise ValueError(f"semantic ids are not unique, e.g. {clash.first()}")


def utilisation(sids: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Used codes per level and their share of the codebook."""
    keys = level_columns(sids)
    stacked = ", ".join(f"{i + 1}, {c}" for i, c in enumerate(keys))
    used = sids.selectExpr(f"stack({len(keys)}, {stacked}) as (level, code)").groupBy("level").agg(F.count_distinct("code").alias("used"))
    sizes = codebooks.groupBy("level").agg(F.count("*").alias("codes"))
    return sizes.join(used, "level", "left").select("level", "used", "codes", (F.col("used") / F.col("codes")).alias("share"))


def prefix_relatives(sids: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """Other items that share the first ``digits`` codes with a few given query items.

    The output is one row per query and relative; use ``family_sizes`` for a whole catalogue.
    """
    keys = level_columns(sids)[:digits]
    wanted = sids.join(queries.select("item_id"), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), *keys)
    return sids.select("item_id", *keys).join(wanted, keys).where(F.col("item_id") != F.col("query_id")).select("query_id", "item_id")


def family_sizes(sids: DataFrame, digits: int) -> DataFrame:
    keys = level_columns(sids)[:digits]
    return sids.groupBy(*keys).agg(F.count("*").alias("n_items"))


def largest_family(sids: DataFrame) -> DataFrame:
    """Most frequent first digit."""
    return family_sizes(sids, 1).orderBy(F.col("n_items").desc(), "sid_level_1").limit(1)


def colliding_members(sids: DataFrame) -> DataFrame:
    """Members of every code tuple that more than one item has."""
    keys = level_columns(sids)
    shared = sids.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return sids.join(shared, keys).select("item_id", *keys, "n")


def cold_item_ids(new_items: DataFrame, stats: DataFrame, codebooks: DataFrame, levels: int, taken: DataFrame) -> DataFrame:
    """Semantic IDs for new items with frozen statistics and codebooks; dedup digits continue after ``taken``."""
    codes = quantise(apply_standardisation(new_items, stats), codebooks)
    return add_dedup_digit(semantic_ids(codes, levels), taken)
