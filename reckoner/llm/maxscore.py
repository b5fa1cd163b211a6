"""Exact top-k inner products over integer vectors with MaxScore."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckoner.llm.common import pick, stage

SHARD_ROWS = 16_384
QUERY_ROWS = 65_536


class Shard:
    """Vectors of a shard with one posting list per term. A term is a dimension and a sign; its impact is |component|."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        for d in range(vectors.shape[1]):
            column = np.ascontiguousarray(self.vectors[:, d])
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                impacts = column[rows] * sign
                self.lists[d, sign] = rows, impacts, int(impacts.max()) if len(rows) else 0

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the best k rows of the shard other than id ``own``, by falling score and rising id.

        ``floor``: a score that k rows of the table are known to reach; rows below it are of no use.

        The terms whose sign agrees with the query's can raise a score, by at most weight x top impact each; the opposite
        terms only lower it. Terms are sorted by that bound. Those at the low end whose bounds sum to less than the floor
        are non-essential: a row in none of the other lists cannot reach it. The essential lists are traversed and summed.
        Rows whose sum, with the bounds of all non-essential terms, still reaches the floor are probed in these terms one
        by one, from the highest bound, as long as they can reach it. Rows that are left get the opposite terms too.
        Without a positive floor a row in no list may count, so all rows are probed.
        """
        dims = np.flatnonzero(query)
        terms = [(int(d), 1 if query[d] > 0 else -1, abs(int(query[d]))) for d in dims]
        terms.sort(key=lambda t: (t[2] * self.lists[t[0], t[1]][2], t[0]))
        reach = np.cumsum([0, *(w * self.lists[d, s][2] for d, s, w in terms)]).tolist()
        split = 0 if floor is None or floor <= 0 else next((i for i in range(len(terms)) if reach[i + 1] >= floor), len(terms))
        sums = np.zeros(len(self.ids), dtype=np.int64)
        for d, s, w in terms[split:]:
            rows, impacts, _ = self.lists[d, s]
            sums[rows] += w * impacts
        if floor is None:
            rows = np.arange(len(sums))
        else:
            rows = np.flatnonzero(sums + reach[split] >= floor)
            for at in range(split - 1, -1, -1):
                if not len(rows):
                    break
                d, s, w = terms[at]
                sums[rows] += w * np.maximum(self.vectors[rows, d] * s, 0)
                rows = rows[sums[rows] + reach[at] >= floor]
        scores = self.vectors[rows] @ query
        usable = self.ids[rows] != own
        if floor is not None:
            usable &= scores >= floor
        rows, scores = rows[usable], scores[usable]
        if len(rows) > k:  # rows are in order of id, so of equal scores the first stay
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        return list(zip(scores.tolist(), self.ids[rows].tolist()))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``_id`` and ``_v`` (array<int>): floor(scale * x). Rows that are null or hold null or non-finite parts are left out."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    parts = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), parts.alias("_v"))


def _matrix(lists: list, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``width``."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


def _search_shard(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Every query of the block against the shard."""
    found: list[tuple[int, int, int]] = []
    if candidates.num_rows and queries.num_rows:
        left, right = candidates.column("_v").to_pylist(), queries.column("_query").to_pylist()
        width = max(map(len, left + right))
        shard = Shard(candidates.column("_id").to_numpy(), _matrix(left, width))
        floors = queries.column("_floor").to_pylist()
        for own, query, floor in zip(queries.column("_own").to_pylist(), _matrix(right, width), floors):
            found.extend((own, i, score) for score, i in shard.search(own, query, k, floor))
    columns = zip(*found) if found else ([], [], [])
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _visit(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    keys = ("_shard", "_block")
    grouped = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys))
    return grouped.applyInArrow(partial(_search_shard, k=k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(
    vectors: DataFrame,
    is_query: str,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``is_query`` (a SQL condition on ``_id``) the ``k`` rows with other
    ids of the highest integer inner product, ties to the smaller id.

    Rows are dealt to shards of about ``shard_rows`` by a hash of the id and queries to blocks of ``query_rows``, so the
    size of a task does not depend on the data; a task holds one shard and one block. First every query visits the shard
    it lives in. The k-th score found there is a floor for the visits to all other shards, where MaxScore then leaves most
    lists early. A query's results, k for each shard, are merged last.

    Rows with a null id, and vectors that are null or hold null or non-finite parts, take no part, as queries or as
    candidates. Vectors of different lengths are compared as if filled up with zeros. Ids are expected to be unique: rows
    that repeat an id and vector are taken once, rows with one id and several vectors are candidates each, and the lists
    of such queries are merged. An empty table gives no rows.
    """
    rows = stage(integer_vectors(pick(vectors, _id=id_col, _vector=vector_col), "_id", "_vector", scale).distinct())
    queries = rows.where(is_query).select(F.col("_id").alias("_own"), F.col("_v").alias("_query"))
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    no_floor = F.lit(None).cast("long").alias("_floor")
    home = queries.withColumn("_shard", F.pmod(F.xxhash64("_own"), F.lit(shards)).cast("int"))
    first = stage(_visit(rows.withColumn("_block", F.lit(-1)), home.select("*", F.lit(-1).alias("_block"), no_floor), k))
    floors = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_low"))
    floors = floors.select(F.col("query_id").alias("_own"), F.when(F.col("_n") >= k, F.col("_low")).alias("_floor"))
    block = F.pmod(F.xxhash64("_own", F.lit(1)), F.lit(blocks)).cast("int").alias("_block")
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    away = home.join(floors, "_own", "left").select("_own", "_query", "_floor", block, "_shard", F.explode(numbers).alias("_to"))
    away = away.where(F.col("_to") != F.col("_shard")).drop("_shard").withColumnRenamed("_to", "_shard")
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    found = first.unionByName(_visit(spread, away, k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
