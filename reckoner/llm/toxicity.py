"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm.common import pick, shielded, stage, unshielded, with_fields

# The fit is bounded: at most so many labelled documents of each class, of at most so many characters each, by a hash of
# the id. Scoring has no bounds.
TRAIN_PER_CLASS = 1_200
TRAIN_CHARS = 8_000
LEAST_STEPS = 40  # of each round, so that few documents get more passes

WINDOW, STRIDE = 48, 40
_HIDDEN, _WORD_DIM, _CHAR_DIM = 8, 8, 16
_WORD_ROWS, _CHAR_ROWS = 1 << 14, 1 << 16
_GRAMS = (3, 5)
_CODES, _PLACES = 0x2100, 64
_CHUNK_CHARS, _CHUNK_WINDOWS, _MEMO_WORDS = 1_000_000, 1_024, 150_000
_OVERLAP_CHARS = 400
_SPACE = re.compile(r"\s")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which characters belong to words, and random hash factors by character and by place in a word."""
    draw = np.random.default_rng(5)
    inside = np.array([chr(i).isalnum() for i in range(_CODES)])
    return inside, *(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (_CODES, _PLACES))


_INSIDE, _CODE_HASH, _PLACE_HASH = _tables()


@dataclass
class Words:
    """The distinct words of some texts and the number of the word at every place."""

    sequence: np.ndarray  # numbers of distinct words, text after text
    counts: np.ndarray  # words of each text
    hashes: np.ndarray  # of the distinct words
    codes: np.ndarray
    starts: np.ndarray  # where each distinct word first stands in the codes
    ends: np.ndarray


@dataclass
class Features:
    """Rows of the input tables for some distinct words."""

    word_rows: np.ndarray
    gram_rows: np.ndarray  # word after word
    gram_starts: np.ndarray


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def read_words(texts: list[str]) -> Words:
    """Cut lower-cased texts into runs of letters and digits; every character beyond the table counts as a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = codes >= _CODES
    if high.any():
        codes = np.where(high, codes % np.uint32(_CODES), codes)
    starts, ends = _spans(_INSIDE[codes] | high)
    opened = np.zeros(len(codes), dtype=np.int32)
    opened[starts] = starts
    place = (np.arange(len(codes), dtype=np.int32) - np.maximum.accumulate(opened)) & (_PLACES - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE_HASH[codes] * _PLACE_HASH[place], dtype=np.uint64)])
    distinct, first, sequence = np.unique(sums[ends] - sums[starts], return_index=True, return_inverse=True)
    lengths = np.cumsum([len(t) + 1 for t in lowered])
    counts = np.diff(np.searchsorted(starts, lengths), prepend=0)
    return Words(sequence, counts, distinct, codes, starts[first], ends[first])


def read_features(words: Words, chosen: np.ndarray) -> Features:
    """Table rows of the chosen distinct words; n-grams are taken from each word between two spaces."""
    begin, size = words.starts[chosen], words.ends[chosen] - words.starts[chosen] + 2
    total = np.cumsum(size)
    owner = np.repeat(np.arange(len(chosen)), size)
    inner = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
    edge = (inner == 0) | (inner == size[owner] - 1)
    at = np.where(edge, 0, begin[owner] + inner - 1)
    values = np.where(edge, _CODE_HASH[0x20], _CODE_HASH[words.codes[at]]) if len(at) else np.zeros(0, np.uint64)
    rows, owners = [], []
    for n in _GRAMS:
        width = max(len(values) - n + 1, 0)
        gram = np.zeros(width, dtype=np.uint64)
        for j in range(n):
            gram += values[j : j + width] * _PLACE_HASH[j]
        whole = owner[:width] == owner[n - 1 : n - 1 + width]
        rows.append(_mixed(gram[whole], _CHAR_ROWS))
        owners.append(owner[:width][whole])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    gram_starts = np.searchsorted(owners[order], np.arange(len(chosen)))
    return Features(_mixed(words.hashes[chosen], _WORD_ROWS), rows[order], gram_starts)


def _mixed(hashes: np.ndarray, rows: int) -> np.ndarray:
    spread = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(40)).astype(np.int64) % rows


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every overlapping window, and where each text's windows start.

    A text without words has one empty window.
    """
    per_text = np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1
    starts = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(counts)), per_text)
    inner = (np.arange(len(owner)) - starts[owner]) * STRIDE
    first = (np.cumsum(counts) - counts)[owner] + inner
    return first, np.minimum(WINDOW, counts[owner] - inner), starts


def _grid(words: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(step, window) numbers of distinct words, shifted by one; 0 is no word."""
    steps = np.arange(WINDOW)[:, None]
    at = np.minimum(first[None, :] + steps, max(len(words.sequence) - 1, 0))
    numbers = words.sequence[at] + 1 if len(words.sequence) else np.zeros(at.shape, np.int64)
    return np.where(steps < size[None, :], numbers, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters: ``word`` and ``char`` tables, input weights ``w`` of both directions, recurrent ``u0`` and ``u1``,
    attention ``v``, output ``o``, biases."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        draw, h = np.random.default_rng(seed), _HIDDEN
        shapes = {
            "word": (_WORD_ROWS, _WORD_DIM), "char": (_CHAR_ROWS, _CHAR_DIM), "w": (_WORD_DIM + _CHAR_DIM, 6 * h),
            "b": (6 * h,), "u0": (h, 3 * h), "u1": (h, 3 * h), "v": (2 * h,), "o": (2 * h,), "c": (1,),
        }
        scale = {"word": 0.1, "char": 0.1, "w": 0.3, "u0": 0.3, "u1": 0.3, "v": 0.1, "o": 0.3}
        p = {k: (draw.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}
        return cls(p)

    def inputs(self, words: Features) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the words, and the root of each word's number of n-grams."""
        n = len(words.word_rows)
        if not n:
            return np.zeros((0, _WORD_DIM + _CHAR_DIM), np.float32), np.zeros((0, 1), np.float32)
        grams = np.add.reduceat(self.p["char"][words.gram_rows], words.gram_starts, axis=0)
        root = np.sqrt(np.diff(np.append(words.gram_starts, len(words.gram_rows)))).astype(np.float32)[:, None]
        return np.concatenate([self.p["word"][words.word_rows], grams / root], axis=1), root

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs (direction, word, gates) of every distinct word below a row for no word, whose closed gate keeps the state."""
        none = np.zeros((1, 6 * _HIDDEN), np.float32)
        none[0, :_HIDDEN] = none[0, 3 * _HIDDEN : 4 * _HIDDEN] = -60
        both = np.concatenate([none, vectors @ self.p["w"] + self.p["b"]])
        return np.ascontiguousarray(both.reshape(-1, 2, 3 * _HIDDEN).swapaxes(0, 1))

    def run(self, grid: np.ndarray, table: np.ndarray, trace: bool = False):
        """Logits of the windows; with ``trace`` also what the backward pass needs."""
        steps, n, h = *grid.shape, _HIDDEN
        states = np.empty((2, steps, n, h), np.float32)
        gates = []
        for side in (0, 1):
            part, u = table[side], self.p[f"u{side}"]
            state, kept = np.zeros((n, h), np.float32), [None] * steps
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x, g = part.take(grid[t], axis=0), state @ u
                zr = x[:, : 2 * h] + g[:, : 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:, :h], zr[:, h:]
                c = r * g[:, 2 * h :]
                c += x[:, 2 * h :]
                np.tanh(c, out=c)
                if trace:
                    kept[t] = (z, r, c, g[:, 2 * h :], state)
                new = states[side, t]
                np.subtract(c, state, out=new)
                new *= z
                new += state
                state = new
            gates.append(kept)
        v, o = self.p["v"], self.p["o"]
        scores = np.where(grid > 0, states[0] @ v[:h] + states[1] @ v[h:], np.float32(-1e9))
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        if not trace:  # the output is linear in the pooled states
            return (weights * (states[0] @ o[:h] + states[1] @ o[h:])).sum(axis=0) + self.p["c"][0]
        states = np.concatenate([states[0], states[1]], axis=2)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        return pooled @ o + self.p["c"][0], (states, gates, weights, pooled)

    def gradients(self, words: Features, grid: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss; the tables' gradients are dense."""
        h = _HIDDEN
        vectors, root = self.inputs(words)
        logits, (states, gates, weights, pooled) = self.run(grid, self.projected(vectors), trace=True)
        d_logit = ((_sigmoid(logits) - target) * weight / weight.sum()).astype(np.float32)
        grad = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weights * (d_weight - (weights * d_weight).sum(axis=0))
        grad["v"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weights[:, :, None] * d_pooled + d_score[:, :, None] * self.p["v"]
        d_gates = np.zeros((*grid.shape, 6 * h), np.float32)
        for side in (0, 1):
            u, d_u, carried = self.p[f"u{side}"], np.zeros((h, 3 * h), np.float32), np.zeros((grid.shape[1], h), np.float32)
            for t in range(len(grid) - 1, -1, -1) if side == 0 else range(len(grid)):
                z, r, c, g, before = gates[side][t]
                d = d_states[t, :, side * h : (side + 1) * h] + carried
                d_z = d * (c - before) * z * (1 - z)
                d_c = d * z * (1 - c * c)
                d_r = d_c * g * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_gates[t, :, side * 3 * h : (side + 1) * 3 * h] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_u += before.T @ d_g
                carried = d * (1 - z) + d_g @ u.T
            grad[f"u{side}"] = d_u
        flat, d_flat = grid.ravel(), d_gates.reshape(-1, 6 * h)
        order = np.argsort(flat, kind="stable")
        numbers, first = np.unique(flat[order], return_index=True)
        by_word = np.add.reduceat(d_flat[order], first, axis=0)
        real = numbers > 0
        numbers, by_word = numbers[real] - 1, by_word[real]
        grad["w"], grad["b"] = vectors[numbers].T @ by_word, by_word.sum(axis=0)
        d_vectors = np.zeros_like(vectors)
        d_vectors[numbers] = by_word @ self.p["w"].T
        grad["word"] = _scattered(words.word_rows, d_vectors[:, :_WORD_DIM], _WORD_ROWS)
        per_word = np.diff(np.append(words.gram_starts, len(words.gram_rows)))
        d_grams = np.repeat(d_vectors[:, _WORD_DIM:] / np.maximum(root, 1), per_word, axis=0)
        grad["char"] = _scattered(words.gram_rows, d_grams, _CHAR_ROWS)
        return grad


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, d], size) for d in range(values.shape[1])], axis=1).astype(np.float32)


def _subset(words: Words, grid: np.ndarray) -> tuple[Features, np.ndarray]:
    """Features of only the words of these windows, and the grid of their numbers."""
    used, inverse = np.unique(grid, return_inverse=True)
    has_none = len(used) > 0 and used[0] == 0
    numbers = used[1:] - 1 if has_none else used - 1
    return read_features(words, numbers), inverse.reshape(grid.shape) + (0 if has_none else 1)


class _Memo:
    """Gate inputs of words seen before, by hash; starts anew when full."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = self.network.projected(np.zeros((0, _WORD_DIM + _CHAR_DIM), np.float32))

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The table, and the row in it of every distinct word."""
        if len(self.rows) + len(words.hashes) > _MEMO_WORDS:
            self._forget()
        rows = np.fromiter((self.rows.get(h, -1) for h in words.hashes.tolist()), np.int64, len(words.hashes))
        new = np.flatnonzero(rows < 0)
        if len(new):
            more = self.network.projected(self.network.inputs(read_features(words, new))[0])[:, 1:]
            used = len(self.rows) + 1
            if used + len(new) > self.table.shape[1]:
                room = np.zeros((2, max(self.table.shape[1], len(new)), 3 * _HIDDEN), np.float32)
                self.table = np.concatenate([self.table, room], axis=1)
            self.table[:, used : used + len(new)] = more
            rows[new] = np.arange(used, used + len(new))
            self.rows.update(zip(words.hashes[new].tolist(), rows[new].tolist()))
        return self.table, rows


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        for k, g in grad.items():
            m, s = self.m[k], self.s[k]
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            self.p[k] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-7))


def window_logits(words: Words, memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, and where each text's windows start."""
    first, size, starts = windows_of(words.counts)
    table, rows = memo.look_up(words)
    rows = np.concatenate([[0], rows])
    parts = [
        memo.network.run(rows[_grid(words, first[i : i + _CHUNK_WINDOWS], size[i : i + _CHUNK_WINDOWS])], table)
        for i in range(0, len(first), _CHUNK_WINDOWS)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32), starts


def fit(texts: list[str], labels: np.ndarray, rounds: int = 5, batch: int = 384, seed: int = 11) -> Network:
    """Train on labelled documents of which only some windows are toxic.

    The first round takes a document's label for a sample of its windows. Each later round scores all windows and takes
    the two highest of every document and a sample of the rest of the clean ones. Every fifth document is kept aside: the
    output bias is shifted so that the best cut of their highest scores lies at one half. Without both classes the
    network scores every text by the share of toxic labels.
    """
    network = Network.fresh()
    if len(set(labels.tolist())) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.0
        network.p = {k: np.zeros_like(v) for k, v in network.p.items()}
        network.p["c"][0] = np.log(max(share, 1e-4) / max(1 - share, 1e-4))
        return network
    words = read_words(texts)
    first, size, starts = windows_of(words.counts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(first))))
    aside = np.arange(len(texts)) % 5 == 4
    draw = np.random.default_rng(seed)
    adam = _Adam(network.p, 0.01)
    for number in range(rounds):
        lottery = draw.random(len(first))
        if number == 0:
            rank = np.lexsort((lottery, owner))
            place = np.arange(len(first)) - starts[owner[rank]]
            chosen = rank[place < 8]
        else:
            logits, _ = window_logits(words, _Memo(network))
            rank = np.lexsort((-logits, owner))
            place = np.arange(len(first)) - starts[owner[rank]]
            more = (labels[owner[rank]] == 0) & (lottery < 0.15)
            top = np.where(labels[owner[rank]] == 1, 1, 2)
            chosen = rank[(place < top) | more]
        chosen = draw.permutation(chosen[~aside[owner[chosen]]])
        target = labels[owner[chosen]].astype(np.float32)
        ones = max(target.sum(), 1)
        weight = np.where(target == 1, (len(target) - ones) / ones, 1.0).astype(np.float32)
        adam.rate = 0.01 if number < rounds - 2 else 0.003
        some = min(batch, max(32, len(chosen) // 16))
        passes = max(1 if number == 0 else 2, -(-LEAST_STEPS * some // len(chosen)))
        for _ in range(passes):
            for i in range(0, len(chosen), some):
                part = chosen[i : i + some]
                subset, grid = _subset(words, _grid(words, first[part], size[part]))
                adam.step(network.gradients(subset, grid, target[i : i + some], weight[i : i + some]))
    logits, _ = window_logits(words, _Memo(network))
    tops = np.maximum.reduceat(logits, starts)
    network.p["c"][0] -= best_cut(tops[aside], labels[aside]) if 0 < labels[aside].sum() < aside.sum() else best_cut(tops, labels)
    return network


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """A cut in the gap of the scores whose upper side has the best F1, nearer to that side: texts longer than those of the
    fit have more windows, so clean ones have higher scores."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(np.argmax(f1))
    low = scores[order[at + 1]] if at + 1 < len(order) else scores[order[at]] - 1
    return float(0.65 * scores[order[at]] + 0.35 * low)


def _parts(text: str) -> list[str]:
    """A very long text in overlapping parts, so that no window is lost at a cut."""
    parts, start = [], 0
    while len(text) - start > _CHUNK_CHARS:
        end = start + _CHUNK_CHARS
        parts.append(text[start:end])
        space = _SPACE.search(text, end - _OVERLAP_CHARS, end)
        start = space.start() if space else end - _OVERLAP_CHARS
    return [*parts, text[start:]]


def _score_batches(batches: Iterator[pa.RecordBatch], model: Broadcast, text_at: int) -> Iterator[pa.RecordBatch]:
    memo = _Memo(Network(model.value))
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        owners: list[int] = []
        texts: list[str] = []
        held = 0

        def flush() -> None:
            if texts:
                logits, starts = window_logits(read_words(texts), memo)
                np.maximum.at(scores, owners, _sigmoid(np.maximum.reduceat(logits, starts).astype(np.float64)))

        for row, text in enumerate(batch.column(text_at)):
            for part in _parts(text.as_py() or ""):
                owners.append(row)
                texts.append(part)
                held += len(part)
                if held >= _CHUNK_CHARS:
                    flush()
                    owners, texts, held = [], [], 0
        flush()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "_score"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fit on at most ``TRAIN_PER_CLASS`` labelled documents of each class that are not held out.

    Twice as many ids are drawn from the labels alone, by a hash; only these few ids are broadcast to find the texts, and
    the texts of at most ``TRAIN_CHARS`` characters come to the driver. An id's label is 1 if any of its labels is; other
    labels than 0 and 1 are ignored.
    """
    marks = pick(labels, _id=id_col, _label=label_col)
    marks = marks.where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    marks = marks.groupBy("_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = [marks.where(F.col("_label") == y).orderBy(order, "_id").limit(2 * TRAIN_PER_CLASS) for y in (0, 1)]
    chosen = stage(chosen[0].unionByName(chosen[1]).withColumn("_order", order))
    rows = pick(docs, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    rows = rows.where(F.length("_text").between(1, TRAIN_CHARS)).join(F.broadcast(chosen), "_id")
    found: dict[int, list] = {0: [], 1: []}
    for r in rows.select("_order", "_text", "_label").orderBy("_order", "_text").collect():
        if len(found[r["_label"]]) < TRAIN_PER_CLASS:
            found[r["_label"]].append((r["_order"], r["_text"], r["_label"]))
    both = sorted(found[0] + found[1])
    return fit([text for _, text, _ in both], np.array([label for *_, label in both], dtype=np.int64))


def score(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (0 to 1): the highest score of all overlapping windows of the whole text.

    Rows are scored where they are, without a shuffle; the network is a few MB whatever the data. Null and empty texts
    have one empty window and get the score of no words. Other columns pass through; a ``_score`` is replaced.
    """
    names = docs.columns
    at = names.index(text_col)
    docs = shielded(docs)
    docs = docs.withColumn(f"in{at}", F.col(f"in{at}").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(network.p)
    out = with_fields(docs.schema, _score=T.DoubleType())
    return unshielded(docs.mapInArrow(partial(_score_batches, model=model, text_at=at), out), names, ["_score"])
