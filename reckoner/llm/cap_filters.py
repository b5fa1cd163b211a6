"""Near-duplicate vectors by spherical-cap filters: random product codes, list decoding, a join on filters, verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import pick, stage
from reckoner.llm.components import components

THRESHOLD = 0.93
CODES = 12  # independent codes, each with its own rotation
CODEWORDS = 128  # in each of the two parts of a code: CODEWORDS ** 2 filters
CAP = 3.5  # a vector passes a filter whose inner product is this many standard deviations of a random one, at most
RECALL = 0.985  # share of pairs at exactly the threshold that are to meet; the cap falls until random pairs do
_TRIALS, _STEP = 1_000, 0.1
BLOCK_ROWS = 512
_SMALL_GROUP = 48
_PAIRS = 20_000
_COLUMNS = 2_048


@lru_cache(maxsize=256)
def _code(number: int, dims: int, codewords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The random rotation of a code and the unit codewords of its two parts."""
    draw = np.random.default_rng([41, number, dims])
    rotation, _ = np.linalg.qr(draw.standard_normal((dims, dims)))
    cut = (dims + 1) // 2
    return rotation, *(_codewords(draw, d, codewords) for d in (cut, dims - cut))


def _codewords(draw: np.random.Generator, dims: int, n: int) -> np.ndarray:
    """Unit codewords of one part. A part of few dimensions has room for few: two in one dimension, 16 in two, 64 in three."""
    if dims <= 1:
        return np.array([[1.0], [-1.0]])
    words = draw.standard_normal((min(n, 4**dims), dims))
    return words / np.linalg.norm(words, axis=1, keepdims=True)


@lru_cache(maxsize=256)
def cap_for(dims: int, threshold: float, codes: int, codewords: int, cap: float, recall: float = RECALL) -> float:
    """The largest cap, from ``cap`` down in steps, with which seeded random pairs at the threshold meet often enough.

    Short vectors and low thresholds need wider caps. At a cap of zero every vector passes about half of all filters.
    """
    if dims < 2:
        return cap
    draw = np.random.default_rng([43, dims])
    a, b = draw.standard_normal((2, _TRIALS, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(max(1 - threshold**2, 0.0)) * b
    while cap > 0:
        lists = (decode(x, codes, codewords, cap) for x in (a, b))
        if np.mean([len(np.intersect1d(x, y, assume_unique=True)) > 0 for x, y in zip(*lists)]) >= recall:
            break
        cap = round(cap - _STEP, 6)
    return max(cap, 0.0)


def decode(vectors: np.ndarray, codes: int, codewords: int, cap: float) -> list[np.ndarray]:
    """For unit vectors of one length, the sorted numbers of all product filters within the cap.

    A filter is a pair of codewords of one code; its inner product is the mean of the two parts'. A codeword is of use only
    when the best partner in the other part lifts it over the limit, so few pairs are looked at. A vector with fewer filters
    than there are codes also gets the nearest filter of every code, so none is left without.
    """
    dims = vectors.shape[1]
    cut = (dims + 1) // 2
    limit = cap * np.sqrt(2 / dims)
    found: list[list[np.ndarray]] = [[] for _ in vectors]
    nearest = np.zeros((len(vectors), codes), dtype=np.int64)
    for number in range(codes):
        rotation, first, second = _code(number, dims, codewords)
        turned = vectors @ rotation
        left = turned[:, :cut] @ first.T
        right = turned[:, cut:] @ second.T if dims > cut else np.zeros((len(vectors), len(second)))
        tops = left.max(axis=1), right.max(axis=1)
        nearest[:, number] = (number * codewords + left.argmax(axis=1)) * codewords + right.argmax(axis=1)
        for row in np.flatnonzero(tops[0] + tops[1] >= limit).tolist():
            a, b = left[row], right[row]
            i = np.flatnonzero(a >= limit - tops[1][row])
            j = np.flatnonzero(b >= limit - tops[0][row])
            rows, columns = np.nonzero(a[i][:, None] + b[j] >= limit)
            found[row].append((number * codewords + i[rows]) * codewords + j[columns])
    for row, parts in enumerate(found):
        if sum(map(len, parts)) < codes:
            parts.append(nearest[row])
    return [np.unique(np.concatenate(parts)) for parts in found]


def _add_filters(
    batches: Iterator[pa.RecordBatch], at: int, threshold: float, codes: int, codewords: int, cap: float
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(at).to_pylist()
        lengths = np.array([len(v) for v in vectors])
        filters: list = [None] * len(vectors)
        for dims in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dims)
            x = np.array([vectors[r] for r in rows], dtype=np.float64).reshape(len(rows), dims)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own = cap_for(dims, threshold, codes, codewords, cap)
            for start in range(0, len(rows), 2048):
                for r, f in zip(rows[start : start + 2048], decode(x[start : start + 2048], codes, codewords, own)):
                    filters[r] = f
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int64()))], [*batch.schema.names, "_filters"])


class _Links:
    """Rows of whole groups: ``group`` numbers, filter of the group, block of the row, unit vectors, filters, copies."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.node = rows.column("_node").to_numpy()
        self.copies = rows.column("_copies").to_numpy()
        self.block = rows.column("_block").to_numpy()
        self.two = rows.column("_p").to_numpy() != rows.column("_q").to_numpy()
        self.filter = rows.column("_filter").to_numpy()
        x = rows.column("_v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        filters = rows.column("_filters").combine_chunks()
        self.ends_of = np.concatenate([[0], np.cumsum(filters.value_lengths().to_numpy())])
        self.filters = filters.flatten().to_numpy()
        self.threshold = threshold
        self.links = np.zeros(len(self.node), dtype=np.int64)
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count pairs for both of their rows."""
        keep = ~self.two[i] | (self.block[i] != self.block[j])
        i, j = i[keep], j[keep]
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        self.ends.append((i, j))

    def _lists(self, rows: np.ndarray, width: int, fill: int) -> np.ndarray:
        """The filters of some rows, one row each, filled up to ``width``."""
        at = self.ends_of[rows][:, None] + np.arange(width)
        inside = at < self.ends_of[rows + 1][:, None]
        return np.where(inside, self.filters[np.minimum(at, len(self.filters) - 1)], fill)

    def small(self, rows: np.ndarray, group: np.ndarray) -> None:
        """Groups of a few rows each, all at once: pairs at distance 1, 2, ... in the order of groups."""
        for d in range(1, len(rows)):
            i = np.flatnonzero(group[rows[:-d]] == group[rows[d:]])
            if not len(i):
                return
            a, b = rows[i], rows[i + d]
            near = np.einsum("nd,nd->n", self.x[a], self.x[b]) >= self.threshold
            a, b = a[near], b[near]
            for s in range(0, len(a), _PAIRS):
                self._take_first(a[s : s + _PAIRS], b[s : s + _PAIRS])

    def _take_first(self, a: np.ndarray, b: np.ndarray) -> None:
        """Of these pairs those whose smallest common filter is the one of their group."""
        width = int(np.diff(self.ends_of).max())
        left, right = self._lists(a, width, -1), self._lists(b, width, -2)
        lower = left < self.filter[a][:, None]
        again = np.zeros(len(a), dtype=bool)
        for k in range(width):
            again |= lower[:, k] & (left[:, k : k + 1] == right).any(axis=1)
        self.take(a[~again], b[~again])

    def large(self, rows: np.ndarray) -> None:
        """A group of many rows: products of matrices, of the vectors and of the marks of smaller filters."""
        near = np.triu(self.x[rows] @ self.x[rows].T >= self.threshold, 1)
        size = self.ends_of[rows + 1] - self.ends_of[rows]
        at = np.repeat(self.ends_of[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lower = self.filters[at] < self.filter[rows[0]]
        owner, marks = np.repeat(np.arange(len(rows)), size)[lower], self.filters[at][lower]
        _, number, count = np.unique(marks, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
        for start in range(0, int(number.max()) + 1 if len(number) else 0, _COLUMNS):
            part = (number >= start) & (number < start + _COLUMNS)
            table = np.zeros((len(rows), _COLUMNS), np.float32)
            table[owner[part], number[part] - start] = 1
            near &= table @ table.T == 0
        i, j = np.nonzero(near)
        self.take(rows[i], rows[j])

    def result(self) -> pa.RecordBatch:
        """Per linked row its links, and an edge to a neighbour that makes a spanning forest of the pairs found here."""
        root = {}

        def top(n: int) -> int:
            while root.setdefault(n, n) != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for a, b in self.ends:
            for m, n in zip(self.node[a].tolist(), self.node[b].tolist()):
                m, n = top(m), top(n)
                if m != n:
                    root[max(m, n)] = min(m, n)
        linked = np.flatnonzero(self.links)
        nodes = self.node[linked]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(self.links[linked]), pa.array([top(n) for n in nodes.tolist()], pa.int64())],
            ["_node", "_links", "_root"],
        )


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; groups that span batches are put together before they are compared."""
    keys = ["_label", "_dims", "_filter", "_p", "_q"]

    def compared(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        for dims in np.unique(rows.column("_dims").to_numpy()).tolist():
            part = np.flatnonzero(rows.column("_dims").to_numpy() == dims)
            links = _Links(rows.take(pa.array(part)), threshold)
            own = group[part]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sizes = np.diff(np.append(starts, len(own)))
            links.small(np.flatnonzero(np.repeat(sizes <= _SMALL_GROUP, sizes)), own)
            for s, n in zip(starts[sizes > _SMALL_GROUP].tolist(), sizes[sizes > _SMALL_GROUP].tolist()):
                links.large(np.arange(s, s + n))
            yield links.result()

    def groups(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            values = rows.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        group = groups(held)
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield from compared(held.slice(0, whole), group[:whole])
            held = held.slice(whole)
    if held is not None:
        yield from compared(held, groups(held))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    codes: int = CODES,
    codewords: int = CODEWORDS,
    cap: float = CAP,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` for every row: links between rows of one label whose cosine
    (double precision) is at least ``threshold`` and that share a filter. No pair below the threshold links.

    Equal vectors of one label are one node with a number of copies, whose rows link to each other. A node is decoded to
    all filters within its cap; nodes meet by (label, length, filter). A bucket of many nodes is dealt into blocks that
    meet in pairs. A pair that shares several filters is counted at the smallest. Of a group only counts for each node and
    a spanning forest come out, never its pairs. The cap falls below ``cap`` where the length of the vectors or the threshold
    ask for it, so that a pair at exactly the threshold meets with a chance of ``RECALL``.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite parts, link with nothing: they keep
    their own id as component. Vectors of different lengths do not link. Rows that repeat an id are rows of their own;
    a null id never names a component unless all its ids are null.
    """
    vectors = pick(vectors, _id=id_col, _vector=vector_col, _of=label_col)
    v = F.col("_vector")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("_of").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)
    plain = F.transform(v, lambda c: c.cast("double"))
    rows = vectors.select(
        "_id",
        F.col("_of").cast("string").alias("_label"),
        F.when(F.coalesce(usable, F.lit(False)), plain).alias("_v"),
    )
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()))
    same = rows.where("_v is not null").groupBy("_label", "_v")
    nodes = stage(same.agg(F.min("_row").alias("_node"), F.count("*").alias("_copies"), F.min("_id").alias("_low")))
    add = partial(_add_filters, at=1, threshold=threshold, codes=codes, codewords=codewords, cap=cap)
    kinds = "_label string, _v array<double>, _node long, _copies long"
    decoded = nodes.select("_label", "_v", "_node", "_copies").mapInArrow(add, f"{kinds}, _filters array<long>")
    decoded = stage(decoded.withColumn("_dims", F.size("_v")))

    keys = ["_label", "_dims", "_filter"]
    buckets = decoded.select("_label", "_dims", "_node", F.explode("_filters").alias("_filter"))
    sizes = buckets.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    members = buckets.join(sizes, keys)
    count = F.ceil(F.col("_n") / block_rows).cast("int")
    members = members.withColumn("_blocks", count).withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    members = members.select(
        "_node", "_filter", "_block", F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q")
    )
    meeting = members.join(decoded, "_node").select(*keys, "_p", "_q", "_block", "_node", "_copies", "_v", "_filters")
    order = [*keys, "_p", "_q"]
    meeting = meeting.repartition(*order).sortWithinPartitions(*order)
    found = stage(meeting.mapInArrow(partial(_verify, threshold=threshold), "_node long, _links long, _root long"))

    links = found.groupBy("_node").agg(F.sum("_links").alias("_others"))
    parts = components(found.select("_node", "_root")).select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    known = nodes.join(links, "_node", "left").join(parts, "_node", "left").withColumn("_part", F.coalesce("_part", "_node"))
    known = stage(known)
    lowest = known.groupBy("_part").agg(F.min("_low").alias("_least"))
    known = known.join(lowest, "_part").select("_label", "_v", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_n"), "_least")
    joined = rows.join(known, ["_label", "_v"], "left")
    component = F.coalesce("_least", "_id")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.col("_n").isNull() | (F.col("_n") == 0)).alias("kept"),
    )
