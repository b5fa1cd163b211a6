"""Exact top-K dot products between two vector tables, as a blocked product that Spark shuffles.

The right side is cut into chunks of bounded size by falling norm; one task multiplies some left rows with one chunk and
keeps k entries per left row. A first visit to the longest vectors gives every left row its k-th score; a later chunk is
only sent to rows for which the product of the norms can still reach that score. Nothing is broadcast and nothing passes
through the driver. Masked pairs travel with their left row to the one task that scores them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions.scalars import SCORE_DIGITS
from reckoner.functions.vectors import as_doubles, norm, unit
from reckoner.operators.compose import ranked
from reckoner.operators.ordering import SHORT_ROWS, Rounds, durable, newest, scalar

CHUNK_BYTES = 64 << 20  # vectors of one chunk
PASS_BYTES = 1 << 31  # left rows that are sent to chunks at a time
MEAN_CHUNK_BYTES = 256 << 20  # as doubles; float vectors of a chunk take half of it
PAIR_BYTES = 64 << 20  # pairs that meet one chunk in a task
PAIRS_AT_ONCE = 1 << 15  # of which so many are summed up together
SCORE_CELLS = 4 << 20  # cells of the score matrix held at a time
ROWS_AT_ONCE = 512  # left rows multiplied together
TILE_CELLS = 1 << 20  # cells of one product
EXACT_ROWS = 1 << 15  # pairs multiplied again at a time

_OUT = "left_id long, right_id long, score double"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def _best(score: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of every row, sorted by row and falling score, ties to the smaller column."""
    order = np.lexsort((cols, -score, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - first < k]


def _places(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every id in ``sorted_ids`` and whether it is there at all."""
    rows = np.searchsorted(sorted_ids, ids)
    found = rows < len(sorted_ids)
    found[found] = sorted_ids[rows[found]] == ids[found]
    return rows, found


def _result(left: list, right: list, score: list) -> pa.Table:
    empty = [np.zeros(0)]
    return pa.table(
        {
            "left_id": pa.array(np.concatenate(left or empty).astype("int64")),
            "right_id": pa.array(np.concatenate(right or empty).astype("int64")),
            "score": pa.array(np.concatenate(score or empty).astype("float64")),
        }
    )


def _block_topk(left: np.ndarray, right: np.ndarray, floors: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], k: int):
    """Rows, columns and scores of the ``k`` best of every left row that are not below its floor, without the ``hidden`` cells.

    The right side is gone through in tiles. Once a row has ``k`` entries its floor is the least of them, so of most tiles only
    a few cells are looked at. Products are taken in single precision, with a margin for its error, where numbers are of
    ordinary size; what may pass the floor is multiplied again in double precision.
    """
    floors = floors.copy()
    rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(all="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", left, left))
        longest = np.sqrt(np.einsum("ij,ij->i", right, right).max(initial=0.0))
        short = np.isfinite(length).all() and np.isfinite(longest) and length.max(initial=0.0) * longest < 1e30 and max(length.max(initial=0.0), longest) < 1e30
    a, b = (left.astype("float32"), right.astype("float32")) if short else (left, right)
    slack = length * longest * (left.shape[1] + 8) * 2.0**-23 + (left.shape[1] + 1) * 2.0**-60 * (1 + length + longest) if short else np.zeros(len(left))
    by_column = np.argsort(hidden[1], kind="stable")
    hidden_rows, hidden_cols = hidden[0][by_column], hidden[1][by_column]
    step = max(k, TILE_CELLS // max(1, len(left)))
    for start in range(0, len(right), step):
        with np.errstate(all="ignore"):
            product = a @ b[start : start + step].T
        lo, hi = np.searchsorted(hidden_cols, [start, start + step])
        product[hidden_rows[lo:hi], hidden_cols[lo:hi] - start] = -np.inf
        bounds = floors - 10.0**-SCORE_DIGITS - slack
        open_rows = np.isneginf(floors)
        if k < product.shape[1] and open_rows.any():
            tile_bound = np.partition(np.where(np.isnan(product[open_rows]), -np.inf, product[open_rows]), -k, axis=1)[:, -k].astype("float64")
            bounds[open_rows] = tile_bound - 10.0**-SCORE_DIGITS - 2 * slack[open_rows]
        if short:  # rounded down to single precision, lest a bound rise
            bounds = np.nextafter(bounds.astype("float32"), np.float32(-np.inf))
        found, at = np.divmod(np.flatnonzero(product >= bounds[:, None]), product.shape[1])
        keep = np.isfinite(product[found, at])
        found, at = found[keep], at[keep] + start
        exact = np.concatenate([np.zeros(0), *[
            np.einsum("ij,ij->i", left[found[i : i + EXACT_ROWS]], right[at[i : i + EXACT_ROWS]]) for i in range(0, len(found), EXACT_ROWS)
        ]])
        exact = np.round(exact, SCORE_DIGITS) + 0.0
        keep = np.isfinite(exact) & (exact >= floors[found])
        if not keep.any():
            continue
        found, at, exact = found[keep], at[keep], exact[keep]
        touched = np.zeros(len(left), dtype=bool)
        touched[found] = True
        again = touched[rows]
        pool = np.concatenate([rows[again], found]), np.concatenate([cols[again], at]), np.concatenate([scores[again], exact])
        best = _best(pool[2], pool[0], pool[1], k)
        best_rows, best_scores = pool[0][best], pool[2][best]
        rows = np.concatenate([rows[~again], best_rows])
        cols, scores = np.concatenate([cols[~again], pool[1][best]]), np.concatenate([scores[~again], best_scores])
        last = np.append(best_rows[1:] != best_rows[:-1], True)
        full = np.bincount(best_rows, minlength=len(left)) >= k
        ends = best_rows[last]
        floors[ends] = np.where(full[ends], np.maximum(best_scores[last], floors[ends]), floors[ends])
    return rows, cols, scores


def _topk_group(k: int):
    """The best ``k`` of one right chunk for some left rows; the ids in ``hidden`` and scores below ``floor`` are left out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _result([], [], [])
        order = np.argsort(left.column("id").to_numpy(), kind="stable")
        left_ids, left_vectors = _matrix(left)
        right_ids, right_vectors = _matrix(right)
        right_vectors = right_vectors.astype("float64", copy=False)
        hidden = left.column("hidden").combine_chunks().take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(hidden.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        others = hidden.flatten().to_numpy(zero_copy_only=False)
        floors = left.column("floor").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)[order]
        found_left, found_right, found_score = [], [], []
        for start in range(0, len(left_ids), ROWS_AT_ONCE):
            stop = min(start + ROWS_AT_ONCE, len(left_ids))
            rows = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
            cols, known = _places(right_ids, others[ends[start] : ends[stop]])
            masked = rows[known], cols[known]
            rows, cols, score = _block_topk(left_vectors[start:stop].astype("float64", copy=False), right_vectors, floors[start:stop], masked, k)
            found_left.append(left_ids[start + rows])
            found_right.append(right_ids[cols])
            found_score.append(score)
        return _result(found_left, found_right, found_score)

    return run


def _lists_group(columns: list[str], name: str):
    """Scores of the listed pairs of some left rows with one right chunk; pairs without a vector get null."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("_rows").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        rows, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
        right_ids, right_vectors = _matrix(right)
        cols, known = _places(right_ids, flat.field("other").to_numpy(zero_copy_only=False))
        present = left.column("vector").is_valid().to_numpy()
        known &= present[rows]
        score = np.full(len(rows), np.nan)
        if known.any():
            vectors = left.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            vectors = vectors.reshape(int(present.sum()), -1)
            at, a, b = np.flatnonzero(known), (np.cumsum(present) - 1)[rows[known]], cols[known]
            step = max(1, SCORE_CELLS // vectors.shape[1])
            for i in range(0, len(at), step):
                part = slice(i, i + step)
                score[at[part]] = np.einsum("ij,ij->i", vectors[a[part]], right_vectors[b[part]])
        carried = [flat.field(c) for c in columns]
        return pa.table([left.column("id").take(pa.array(rows)), *carried, pa.array(score, mask=~known)], names=["id", *columns, name])

    return run


def _width(df: DataFrame) -> int:
    """Bytes of one number of the vectors."""
    return 4 if isinstance(df.schema["vector"].dataType.elementType, T.FloatType) else 8


def _plain(df: DataFrame):
    """Vectors of single precision stay so until they are multiplied; all others become doubles."""
    return F.col("vector") if _width(df) == 4 else as_doubles(F.col("vector"))


def _chunks(df: DataFrame, at_least: int, chunk_bytes: int, width: int = 8) -> int:
    """Number of chunks that keeps one chunk's vectors below ``chunk_bytes``."""
    stats = df.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not stats["n"]:
        return 1
    per_chunk = max(1, chunk_bytes // (width * stats["d"]))
    return max(1, min(stats["n"], max(at_least, math.ceil(stats["n"] / per_chunk))))


def _chunk_of(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def norm_chunks(right: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """``(id, vector, norm, rc)`` with chunks numbered by falling norm, and how many there are at most.

    Ranges of (norm, id) are of even size even if all norms are equal.
    """
    right = right.select("id", _plain(right).alias("vector")).withColumn("norm", norm(as_doubles(F.col("vector"))))
    right = durable(right.withColumn("rc", F.lit(0)))  # staged: a join on a literal would become a product of the two sides
    n = _chunks(right, 1, chunk_bytes, _width(right))
    if n == 1:
        return right, 1
    return durable(right.repartitionByRange(n, F.col("norm").desc(), "id").withColumn("rc", F.spark_partition_id())), n


def reaching(rows: DataFrame, head: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``(id, rc, floor)``: the chunks beyond the first that may hold one of the ``k`` best of a left row, and the score to reach.

    No score in a chunk exceeds the product of the row's norm and the chunk's largest. Rows that found fewer than ``k``
    in the first chunk need all. The bounds are one number per chunk.
    """
    floors = head.groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("_n"), F.min("score").alias("_floor"))
    floors = floors.select("id", F.when(F.col("_n") >= k, F.col("_floor")).alias("_floor"))
    bounds = right.where("rc > 0").groupBy("rc").agg(F.max("norm").alias("bound"))
    bounds = bounds.agg(F.collect_list(F.struct("rc", "bound")).alias("bounds"))
    slack = 10.0**-SCORE_DIGITS  # rounding may lift a score to the floor, where the smaller id wins
    norms = rows.select("id", norm(as_doubles(F.col("vector"))).alias("_norm")).join(floors, "id", "left").withColumn("_bounds", scalar(bounds, "bounds"))
    near = F.filter("_bounds", lambda b: F.col("_floor").isNull() | (F.col("_norm") * b.bound * (1 + 1e-9) + slack >= F.col("_floor")))
    return norms.select("id", F.col("_floor").alias("floor"), F.explode(F.transform(near, lambda b: b.rc)).alias("rc"))


def _product(rows: DataFrame, right: DataFrame, n_right: int, k: int, chunk_bytes: int) -> DataFrame:
    """Cogroup ``rows(id, vector, hidden, rc, floor)``, in slices of bounded bytes, with the chunks they ask for.

    Every column gets a new alias: a cogroup whose two sides share attributes loses columns to pruning.
    """
    spread = max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism // n_right)
    size = F.sum(_width(rows) * F.size("vector") + 8 * F.greatest(F.size("hidden"), F.lit(0)))
    slices = rows.groupBy("rc").agg(F.greatest(F.ceil(size / chunk_bytes), F.lit(spread)).cast("int").alias("_slices"))
    sliced = rows.join(slices, "rc").select(
        F.col("rc").alias("rc"),
        F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int").alias("slice"),
        F.col("id").alias("id"),
        F.col("vector").alias("vector"),
        F.col("hidden").alias("hidden"),
        F.col("floor").alias("floor"),
    )
    targets = right.join(slices, "rc").select(
        F.col("rc").alias("rc"),
        F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"),
        F.col("id").alias("id"),
        F.col("vector").alias("vector"),
    )
    return sliced.groupBy("rc", "slice").cogroup(targets.groupBy("rc", "slice")).applyInArrow(_topk_group(k), _OUT)


def blocked_topk(left: DataFrame, right: DataFrame, masked: DataFrame, k: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(left_id, right_id, score)`` with up to ``k`` best pairs per left row of the first right chunk, and as many of all later ones.

    ``left(id, vector)``, ``right(id, vector)``; ``masked(id, other)`` are distinct pairs that must not appear. The list of
    a row's masked ids within one chunk is no longer than the chunk. Chunks beyond the first are visited in passes, each of which
    sends ``PASS_BYTES`` of left rows at most (or to one chunk) and hands on ``k`` entries per row, which are the next floors:
    the disk holds one pass, however many chunks there are.
    """
    right, n_right = norm_chunks(right, chunk_bytes)
    placed = masked.join(right.select(F.col("id").alias("other"), "rc"), "other")
    hidden = placed.groupBy("id", "rc").agg(F.collect_list("other").alias("hidden"))
    if n_right > 1:
        hidden = durable(hidden)
    rows = left.select("id", _plain(left).alias("vector")).withColumn("rc", F.lit(0))
    rows = durable(rows.join(hidden, ["id", "rc"], "left").withColumn("floor", F.lit(None).cast("double")))
    head = _product(rows, right, n_right, k, chunk_bytes)
    if n_right == 1:
        return head
    rounds = Rounds(rows.sparkSession)
    head, later = durable(head), None
    size = rows.agg(F.sum(_width(rows) * F.size("vector") + 32)).first()[0] or 1
    step = max(1, PASS_BYTES // size)
    order = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id")
    best = lambda df: df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
    for first in range(1, n_right, step):
        some = right.where(F.col("rc").between(first, first + step - 1))
        so_far = head if later is None else best(head.unionByName(later))
        further = reaching(rows, so_far, some, k).join(rows.select("id", "vector"), "id").join(hidden, ["id", "rc"], "left")
        further = rounds.stage(further)
        found = _product(further, some, min(step, n_right - first), k, chunk_bytes)
        merged = rounds.stage(best(found if later is None else later.unionByName(found)))
        rounds.drop(further)
        if later is not None:
            rounds.drop(later)
        later = merged
    return head.unionByName(later)


def score_listed(left: DataFrame, right: DataFrame, pairs: DataFrame, chunk_bytes: int = CHUNK_BYTES, name: str = "score") -> DataFrame:
    """``pairs(id, other, ...)`` with the dot product ``name`` of the two vectors; null where one has none.

    The pairs of a left row are gathered per right chunk, fetch its vector once and travel as one row to a task that holds
    the chunk; other columns of the pairs go with them, so nothing is joined back. Bytes moved grow with the pairs, plus one
    left vector per (row, chunk) and one right chunk per task.
    """
    extra = [c for c in pairs.columns if c != "id"]
    right = durable(right)
    n_right = _chunks(right, 1, chunk_bytes)
    gathered = pairs.withColumn("rc", _chunk_of("other", n_right)).groupBy("id", "rc").agg(F.collect_list(F.struct(*extra)).alias("_rows"))
    vectors = left.select("id", as_doubles(F.col("vector")).alias("vector"))
    gathered = durable(gathered.join(vectors, "id", "left"))
    size = gathered.agg(F.sum(8 * F.greatest(F.size("vector"), F.lit(0)) + 24 * F.size("_rows")).alias("b")).first()["b"] or 0
    parallelism = left.sparkSession.sparkContext.defaultParallelism
    slices = max(1, 2 * parallelism // n_right, math.ceil(size / (n_right * chunk_bytes)))
    sliced = gathered.withColumn("slice", _chunk_of("id", slices))
    targets = right.select(
        _chunk_of("id", n_right).alias("rc"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.col("id").alias("id"),
        as_doubles(F.col("vector")).alias("vector"),
    )
    fields = [pairs.schema["id"], *(pairs.schema[c] for c in extra), T.StructField(name, T.DoubleType())]
    return sliced.groupBy("rc", "slice").cogroup(targets.groupBy("rc", "slice")).applyInArrow(_lists_group(extra, name), T.StructType(fields))


def score_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(left_id, right_id, score)`` of the listed pairs ``(id, other)``; pairs of unknown ids are left out."""
    scored = score_listed(left, right, pairs.select("id", "other"), chunk_bytes).where(F.col("score").isNotNull())
    return scored.withColumnsRenamed({"id": "left_id", "other": "right_id"})


def score_dot_topk(user_vecs: DataFrame, item_vecs: DataFrame, seen: DataFrame, k: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Best ``k`` unseen items of every user by dot product; ties to the smaller item id.

    Scores are rounded so that equal items tie exactly.
    """
    users = user_vecs.select(F.col("user_id").alias("id"), "vector")
    items = item_vecs.select(F.col("item_id").alias("id"), "vector")
    relevant = seen.select("user_id", "item_id").distinct().join(user_vecs.select("user_id"), "user_id", "left_semi")
    masked = relevant.select(F.col("user_id").alias("id"), F.col("item_id").alias("other"))
    found = blocked_topk(users, items, masked, k, chunk_bytes)
    return ranked(found.select(F.col("left_id").alias("user_id"), F.col("right_id").alias("item_id"), "score"), k)


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Exact cosine neighbours of every query item, itself left out by key: ``(query_id, item_id, score, rank)``."""
    left = queries.select(F.col("item_id").alias("id"), unit(as_doubles(F.col("embedding"))).alias("vector"))
    right = items.select(F.col("item_id").alias("id"), unit(as_doubles(F.col("embedding"))).alias("vector"))
    itself = queries.select(F.col("item_id").alias("id"), F.col("item_id").alias("other"))
    found = blocked_topk(left, right, itself, k, chunk_bytes)
    return ranked(found.withColumnsRenamed({"left_id": "query_id", "right_id": "item_id"}), k, keys=("query_id",))


def tables_for(near: float, recall: float, bits: int) -> int:
    """Tables needed so that two vectors of cosine ``near`` share a signature of ``bits`` hyperplanes with chance ``recall``."""
    alike = (1 - math.acos(near) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike)))


def _signatures(tables: int, bits: int, seed: int):
    """Adds the signature of every row in every table: which side of each seeded random plane it lies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], tables * bits))
            sides = (vectors @ planes >= 0).reshape(len(batch), tables, bits)
            codes = sides @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype="int32"), codes.ravel().astype("int64"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), lists], ["id", "vector", "codes"])

    return run


def hashed_cosine_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    near: float = 0.9,
    recall: float = 0.95,
    bits: int = 8,
    seed: int = 7,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Approximate cosine neighbours by random hyperplanes: ``(query_id, item_id, score, rank)`` as ``cosine_topk``.

    Scores are exact, but only items that share a signature with the query in one of the tables are compared. The number
    of tables is chosen so that an item of cosine ``near`` is compared with chance ``recall``; nearer ones more often, farther
    ones less, so a list may be short. Every vector travels once per table; a large bucket is cut into parts of
    ``chunk_bytes`` and multiplied in slices, never as a list of pairs. Rows without a vector, and zero vectors, are left out.
    """
    tables = tables_for(near, recall, bits)
    out = "id long, vector array<double>, codes array<long>"

    def signed(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("item_id").cast("long").alias("id"), as_doubles(F.col("embedding")).alias("vector"))
        rows = rows.where(norm(F.col("vector")) > 0).select("id", unit(F.col("vector")).alias("vector"))
        rows = rows.mapInArrow(_signatures(tables, bits, seed), out)
        return rows.select("id", "vector", F.explode("codes").alias("_bucket"))

    right = durable(signed(items))
    parts = right.groupBy("_bucket").agg(F.ceil(F.sum(8 * F.size("vector")) / chunk_bytes).cast("int").alias("_parts"))
    parts = durable(parts)
    chunk = lambda part: (F.shiftleft("_bucket", 20) + part).alias("rc")
    right = right.join(parts, "_bucket").select("id", "vector", chunk(F.pmod(F.xxhash64("id"), F.col("_parts"))))
    rows = signed(queries).join(parts, "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = durable(rows.select("id", "vector", F.array("id").alias("hidden"), chunk(F.col("_part")), F.lit(None).cast("double").alias("floor")))
    found = _product(rows, right, tables << bits, k, chunk_bytes)
    best = found.groupBy(F.col("left_id").alias("query_id"), F.col("right_id").alias("item_id")).agg(F.max("score").alias("score"))
    return ranked(best, k, keys=("query_id",))


def _sums(left: pa.Table, right_ids: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """Weighted vector sums of some left rows; ``right_ids`` are sorted and may repeat, theirs are the rows ``at`` of ``vectors``."""
    others = left.column("other").to_numpy()
    first, end = np.searchsorted(right_ids, others, "left"), np.searchsorted(right_ids, others, "right")
    copies = end - first
    encoded = left.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    users = np.repeat(encoded.indices.to_numpy(), copies)
    cols = np.repeat(first - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
    weights = np.repeat(left.column("weight").to_numpy(), copies)
    order = np.argsort(users, kind="stable")
    users, cols, weights = users[order], cols[order], weights[order]
    starts = np.flatnonzero(np.diff(users, prepend=-1))
    out = np.zeros((len(starts), vectors.shape[1]))
    group = np.cumsum(np.diff(users, prepend=-1) != 0) - 1
    step = max(1, SCORE_CELLS // max(1, vectors.shape[1]))
    for i in range(0, len(users), step):
        part = slice(i, i + step)
        heads = np.flatnonzero(np.diff(group[part], prepend=-1))
        out[group[part][heads]] += np.add.reduceat(weights[part, None] * vectors[at[cols[part]]], heads, axis=0)
    totals = np.add.reduceat(weights, starts) if len(starts) else np.zeros(0)
    lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype="int32"), out.ravel())
    return pa.RecordBatch.from_arrays([encoded.dictionary.take(pa.array(users[starts])), lists, pa.array(totals)], ["id", "vector", "weight"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a chunk and pairs with it, in any order. Sums go on for ``PAIRS_AT_ONCE`` pairs at a time, all of an id
    together."""
    ids, parts, pairs = [], [], []
    for batch in batches:
        is_right = batch.column("vector").is_valid()
        right = batch.filter(is_right)
        if right.num_rows:
            ids.append(right.column("other").to_numpy())
            parts.append(right.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(right.num_rows, -1))
        if right.num_rows < batch.num_rows:
            pairs.append(batch.select(["id", "other", "weight"]).filter(pc.invert(is_right)))
    if not ids or not pairs:
        return
    ids, vectors = np.concatenate(ids), np.concatenate(parts)
    del parts
    at = np.argsort(ids, kind="stable")
    ids = ids[at]
    table = pa.Table.from_batches(pairs)
    del pairs
    codes = table.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PAIRS_AT_ONCE, "right")) - 1)
        yield _sums(table.take(pa.array(order[bounds[start] : bounds[stop]])), ids, at, vectors)
        start = stop


def weighted_means(rows: DataFrame, right: DataFrame, chunk_bytes: int = MEAN_CHUNK_BYTES) -> DataFrame:
    """``(id, vector)``: the mean of the vectors ``right(id, vector)`` that ``rows(id, other, weight)`` name, by weight.

    Rows without a vector do not count. Neither a vector per row is moved nor one per task: rows meet chunks of the right
    side, and one partial sum per (left id, chunk) goes on. Equal pairs are added up first, so the rows of one id that meet
    a chunk are no more than its vectors.
    """
    right = durable(right.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", "vector"))
    n_right = _chunks(right, 1, chunk_bytes)
    pairs = rows.where(F.col("other").isNotNull()).groupBy("id", "other").agg(F.sum("weight").alias("weight"))
    pairs = durable(pairs)
    slices = max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism // n_right, math.ceil(24 * pairs.count() / (n_right * PAIR_BYTES)))
    group = lambda chunk, part: (chunk * F.lit(slices) + part).alias("_group")
    left = pairs.select(
        group(_chunk_of("other", n_right), _chunk_of("id", slices)),
        "id",
        "other",
        F.col("weight").cast("double").alias("weight"),
        F.lit(None).cast(right.schema["vector"].dataType).alias("vector"),
    )
    targets = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        group(_chunk_of("id", n_right), F.col("_part")),
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        F.col("id").alias("other"),
        F.lit(None).cast("double").alias("weight"),
        "vector",
    )
    out = T.StructType([rows.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType())])
    parts = left.unionByName(targets).repartitionById(n_right * slices, "_group").drop("_group").mapInArrow(_sum_rows, out)
    parts = Rounds(rows.sparkSession, SHORT_ROWS).stage(parts)
    if n_right == 1:
        sums = parts
    else:
        parts = parts.select("id", "weight", array_to_vector("vector").alias("_v"))
        sums = parts.groupBy("id").agg(Summarizer.sum(F.col("_v")).alias("_v"), F.sum("weight").alias("weight"))
        sums = sums.select("id", vector_to_array("_v").alias("vector"), "weight")
    return sums.select("id", F.transform("vector", lambda x: x / F.col("weight")).alias("vector"))


def history_state(history: DataFrame, item_vecs: DataFrame, n: int = 20, decay: float = 0.8, order_by=("ts", "k1", "k2", "item_id")) -> DataFrame:
    """User state from the last ``n`` items: mean of their vectors weighted by ``decay ** age``.

    The row limit runs before the shuffle.
    """
    last = newest(history.select("user_id", *dict.fromkeys(["item_id", *order_by])), "user_id", list(order_by), n)
    weights = last.select(F.col("user_id").alias("id"), F.col("item_id").alias("other"), F.pow(F.lit(decay), F.col("age")).alias("weight"))
    return weighted_means(weights, item_vecs.select(F.col("item_id").alias("id"), "vector")).withColumnRenamed("id", "user_id")
