"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm.common import shielded, stage, unshielded, with_fields
from reckoner.llm.components import components
from reckoner.llm.shingles import gram_sets, mixed
from reckoner.operators.ordering import positions

GRAM_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.985  # of a pair exactly at the threshold
BAND_ROWS = 10
BLOCK_GRAMS = 1 << 20
BLOCK_DOCS = 512
_CHUNK_CHARS = 1_000_000
_SLICE = 1 << 16


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` rows that finds a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 31) -> np.ndarray:
    """(set, band) 64-bit hashes of MinHash bands; the number of the band is part of its hash. Sets are not empty."""
    draw = np.random.default_rng(seed)
    n = bands * rows
    flip = draw.integers(0, 1 << 32, n, dtype=np.uint32)
    factor = draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    least = np.empty((len(sets), n), dtype=np.uint32)
    at = 0
    while at < len(sets):  # slices that stay in the processor's cache
        end, held = at + 1, len(sets[at])
        while end < len(sets) and held + len(sets[end]) <= _SLICE:
            held += len(sets[end])
            end += 1
        grams = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for j in range(n):
            least[at:end, j] = np.minimum.reduceat((grams ^ flip[j]) * factor[j], starts)
        at = end
    weights = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = (least.reshape(len(sets), bands, rows).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
    return mixed(parts + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], text_at: int, words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= _CHUNK_CHARS):
                held += len(texts[end])
                end += 1
            sets = gram_sets(texts[start:end], words)
            full = [i for i, s in enumerate(sets) if len(s)]
            found: list = [None] * len(sets)
            for i, hashes in zip(full, band_hashes([sets[i] for i in full], bands, rows) if full else ()):
                found[i] = hashes
            columns = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(found, pa.list_(pa.int64())),
            ]
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*batch.schema.names, "_set", "_grams", "_bands"])
            start = end


def _verify(group: pa.Table, words: int, threshold: float) -> pa.Table:
    """Links within one block, or between the two blocks of a pair: links per set, and a star for each linked part."""
    ids = group.column("_set").to_pylist()
    blocks = group.column("_block").to_numpy()
    copies = group.column("_copies").to_numpy()
    bands = np.array(group.column("_bands").to_pylist(), dtype=np.int64)
    sets = gram_sets(group.column("_text").to_pylist(), words)
    n, sizes = len(sets), np.array([len(s) for s in sets])
    grams, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, gram = np.unique(grams, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    posting_owner = owner[order]
    posting_start = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    two = blocks.min() != blocks.max()
    links = np.zeros(n, dtype=np.int64)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        if two and blocks[i] == blocks.max():
            continue
        mine = gram[first[i] : first[i + 1]]
        begin, size = posting_start[mine], posting_start[mine + 1] - posting_start[mine]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(posting_owner[at], minlength=n)
        near = shared >= threshold * (sizes[i] + sizes - shared)
        near &= blocks != blocks[i] if two else np.arange(n) > i
        near = np.flatnonzero(near)
        if len(near):
            near = near[(bands[near] == bands[i]).any(axis=1)]
        links[i] += copies[near].sum()
        links[near] += copies[i]
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b, key=ids.__getitem__)] = min(a, b, key=ids.__getitem__)
    linked = np.flatnonzero(links)
    return pa.table(
        [
            pa.array([ids[i] for i in linked], pa.binary()),
            pa.array(links[linked], pa.int64()),
            pa.array([ids[top(i)] for i in linked], pa.binary()),
        ],
        names=["_set", "_links", "_root"],
    )


def jaccard_links(sets: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """``_set, _links, _root`` from every place where sets meet. ``sets``: ``_set, _row, _copies, _grams, _bands``.

    Sets that share a band hash are candidates. Buckets of equal band hashes are joined by stars into parts, so that a set
    travels once for its part and not once for each band. A part is cut into blocks of bounded n-grams by size class and
    likeness; blocks that share a bucket meet in pairs. Texts come in by row number, one row for each set.
    """
    keys = sets.select("_set", F.explode("_bands").alias("_key"))
    heads = keys.groupBy("_key").agg(F.min("_set").alias("_head"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    shared = stage(keys.join(heads.drop("_n"), "_key"))
    parts = components(shared.select("_set", "_head").distinct())
    likeness = shared.groupBy("_set").agg(F.min("_head").alias("_like"))
    members = likeness.join(parts.withColumnRenamed("node", "_set"), "_set", "left")
    members = members.withColumn("_cluster", F.coalesce("component", "_set")).drop("component")
    members = members.join(sets.select("_set", "_row", "_copies", "_grams", "_bands"), "_set")
    members = members.withColumn("_class", F.ceil(F.log2(F.col("_grams").cast("double"))).cast("int"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_DOCS), F.expr(f"shiftright({BLOCK_GRAMS}, _class)")))
    placed = positions(members, ["_cluster", "_class"], ["_like", "_set"], "_pos")
    placed = placed.withColumn("_block", F.xxhash64("_cluster", "_class", F.floor(F.col("_pos") / room).cast("long")))
    placed = stage(placed.select("_set", "_row", "_copies", "_bands", "_cluster", "_class", "_block"))

    blocks = placed.groupBy("_cluster", "_block").agg(F.count("*").alias("_n"), F.first("_class").alias("_class"))
    inside = blocks.where(F.col("_n") > 1).select(F.col("_block").alias("_a"), F.col("_block").alias("_b"))
    several = blocks.groupBy("_cluster").agg(F.count("*").alias("_blocks")).where(F.col("_blocks") > 1).select("_cluster")
    touched = placed.join(several, "_cluster").select("_set", "_block", "_class")
    touched = stage(shared.select("_set", "_key").join(touched, "_set").select("_key", "_block", "_class").distinct())
    other = touched.select("_key", F.col("_block").alias("_b"), F.col("_class").alias("_other"))
    across = touched.join(other, "_key").where((F.col("_block") < F.col("_b")) & (F.abs(F.col("_class") - F.col("_other")) < 2))
    across = across.select(F.col("_block").alias("_a"), "_b").distinct()
    meetings = stage(inside.unionByName(across))
    sides = meetings.select("_a", "_b", F.col("_a").alias("_block"))
    sides = sides.unionByName(meetings.where("_a <> _b").select("_a", "_b", F.col("_b").alias("_block")))

    wanted = placed.select("_row", "_set", "_copies", "_bands", "_block")
    loaded = texts.join(wanted, "_row").join(sides, "_block")

    def check(group: pa.Table) -> pa.Table:
        return _verify(group, words, threshold)

    rows = loaded.select("_a", "_b", "_set", "_block", "_copies", "_bands", F.coalesce("_text", F.lit("")).alias("_text"))
    return stage(rows.groupBy("_a", "_b").applyInArrow(check, "_set binary, _links long, _root binary"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = GRAM_WORDS,
    threshold: float = THRESHOLD,
    band_rows: int = BAND_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """``docs`` with ``_class`` (smallest id reachable over links), ``_links`` (other rows linked directly) and ``_kept``
    (true for one row of each class).

    Two rows link when their sets of word ``words``-grams have a Jaccard similarity of at least ``threshold`` and they
    share one of ``bands_for(...)`` MinHash bands; no pair below the threshold links. Rows with equal sets are one set with
    a number of copies: they link to each other, and are compared, counted and shipped once however many there are.

    Texts without words have no n-grams and link with nothing: each is kept, its class is its own id. Null texts count as
    empty, texts of one to four words have one n-gram of all their words. Rows with a null or repeated id are rows of their
    own; a class of null ids only has a null id. The kept row has the smallest id of its class. Other columns pass through;
    one that has the name of an added column is replaced.
    """
    names = docs.columns
    id_col, text_col = (f"in{names.index(c)}" for c in (id_col, text_col))
    docs = shielded(docs)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    columns = docs.columns
    bands = bands_for(threshold, band_rows, recall)
    kinds = with_fields(docs.schema, _set=T.BinaryType(), _grams=T.LongType(), _bands=T.ArrayType(T.LongType()))
    describe = partial(_describe, text_at=columns.index(text_col), words=words, bands=bands, rows=band_rows)
    described = docs.mapInArrow(describe, kinds)
    rows = stage(described.withColumn("_row", F.monotonically_increasing_id()))

    full = rows.where(F.col("_set").isNotNull())
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    sets = full.groupBy("_set").agg(F.count("*").alias("_copies"), F.min(order).alias("_low"))
    sets = stage(sets)
    bands_of = full.select("_row", "_grams", "_bands").join(sets.select("_set", "_copies", F.col("_low.row").alias("_row")), "_row")
    texts = rows.select("_row", F.col(text_col).cast("string").alias("_text"))
    found = jaccard_links(stage(bands_of), texts, words, threshold)

    links = found.groupBy("_set").agg(F.sum("_links").alias("_others"))
    parts = components(found.select("_set", "_root")).select(F.col("node").alias("_set"), F.col("component").alias("_cluster"))
    known = sets.join(links, "_set", "left").join(parts, "_set", "left")
    known = stage(known.withColumn("_cluster", F.coalesce("_cluster", "_set")))
    lowest = known.groupBy("_cluster").agg(F.min("_low").alias("_first"))
    known = known.join(lowest, "_cluster").select(
        "_set", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_n"), "_first"
    )
    joined = rows.join(known, "_set", "left")
    alone = F.col("_first").isNull()
    judged = joined.select(
        *columns,
        F.when(alone, F.col(id_col)).otherwise(F.col("_first.id")).alias("_class"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("_links"),
        (alone | (F.col("_first.row") == F.col("_row"))).alias("_kept"),
    )
    return unshielded(judged, names, ["_class", "_links", "_kept"])
