"""Text quality from a sparse ensemble of rules over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm.common import pick, shielded, stage, unshielded, with_fields
from reckoner.llm.shingles import word_hashes

# Labelled documents of each class that the rules are fitted on; only their statistics come to the driver.
TRAIN_PER_CLASS = 4000
TREES, DEPTH, CUTS, LEAF_ROWS, RATE = 40, 3, 32, 20, 0.3
# Strengths of the lasso that are tried, and its rounds for each.
PENALTIES, ROUNDS = np.geomspace(0.1, 0.0003, 10), 120

# Longer texts are measured part by part.
_PART_CHARS = 1_000_000
# Words that lie this close to an equal one count as recent repeats.
_NEAR_WORDS = 50

# fmt: off
STATISTICS = (
    "log_chars", "log_words", "letters", "upper", "digits", "stops", "marks", "symbols", "newlines", "spaces", "tripled",
    "word_chars", "stutter", "recent", "top_word", "distinct_words", "repeated_grams",
    "log_lines", "line_words", "repeated_lines", "ended_lines", "short_lines",
)
# fmt: on
_LETTER, _UPPER, _DIGIT, _STOP, _MARK, _SYMBOL, _NEWLINE, _SPACE = range(8)
_STOPS, _MARKS = ".,;:!?", "'\"()-"


def _kind(char: str) -> int:
    if char.isalpha():
        return _UPPER if char.isupper() else _LETTER
    if char.isdigit():
        return _DIGIT
    if char == "\n":
        return _NEWLINE
    if char.isspace():
        return _SPACE
    return _STOP if char in _STOPS else _MARK if char in _MARKS else _SYMBOL


_KINDS = np.array([_kind(chr(i)) for i in range(0x2100)] + [_LETTER], dtype=np.uint8)  # the last: all others


def _parts(text: str) -> Iterator[str]:
    """The text in parts that end at a space, if there is one."""
    start = 0
    while len(text) - start > _PART_CHARS:
        end = text.rfind(" ", start + 1, start + _PART_CHARS) + 1 or start + _PART_CHARS
        yield text[start:end]
        start = end
    yield text[start:]


def _share(part: float, whole: float) -> float:
    return float(part) / float(whole) if whole else 0.0


def measure(text: str) -> list[float]:
    """The ``STATISTICS`` of a text, all of it. Those of an empty text are 0."""
    kinds, tripled, hashes = np.zeros(8), 0, []
    for part in _parts(text):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _KINDS[np.minimum(codes, 0x2100)]
        kinds += np.bincount(kind, minlength=8)
        tripled += np.count_nonzero((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (kind[2:] < _NEWLINE))
        hashes.append(word_hashes([part])[0])
    words = np.concatenate(hashes)
    chars, letters, count = len(text), kinds[_LETTER] + kinds[_UPPER], len(words)
    order = np.argsort(words, kind="stable")
    same = np.diff(words[order]) == 0
    runs = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]]))) if count else np.zeros(1)
    grams = words[:-3] * np.uint64(3) + words[1:-2] * np.uint64(5) + words[2:-1] * np.uint64(7) + words[3:]
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        np.log1p(chars),
        np.log1p(count),
        _share(letters, chars),
        _share(kinds[_UPPER], letters),
        *(_share(kinds[k], chars) for k in (_DIGIT, _STOP, _MARK, _SYMBOL, _NEWLINE, _SPACE)),
        _share(tripled, chars),
        _share(letters + kinds[_DIGIT], count),
        _share(np.count_nonzero(words[1:] == words[:-1]), count - 1),
        _share(np.count_nonzero(same & (np.diff(order) <= _NEAR_WORDS)), count),
        _share(runs.max(), count),
        _share(len(runs), count),
        _share(len(grams) - len(np.unique(grams)), len(grams)),
        np.log1p(len(lines)),
        _share(count, len(lines)),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(line.rstrip()[-1] in _STOPS for line in lines), len(lines)),
        _share(sum(len(line) < 20 for line in lines), len(lines)),
    ]


def _measure_batches(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        found = pa.array([measure(text.as_py() or "") for text in batch.column(text_at)], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_stats"])


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    out = with_fields(docs.schema, _stats=T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(partial(_measure_batches, text_at=docs.columns.index(text_col)), out)


@dataclass(frozen=True)
class Rule:
    """All of its bounds hold: ``low < statistic <= high`` for each listed statistic."""

    bounds: tuple[tuple[int, float, float], ...]

    def covers(self, rows: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(rows[:, i] > low) & (rows[:, i] <= high) for i, low, high in self.bounds])

    def column(self, stats: Column) -> Column:
        tests = [stats[i] > low for i, low, _ in self.bounds if np.isfinite(low)]
        tests += [stats[i] <= high for i, _, high in self.bounds if np.isfinite(high)]
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {STATISTICS[i]} <= {high:.4g}" for i, low, high in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over the statistics."""
        terms = [F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights)]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(self.bias))))


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tree_rules(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> list[Rule]:
    """The paths to all nodes of boosted trees, each tree over a random half of the statistics."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)[1:-1])) for column in rows.T]
    bins = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, rows.T)], axis=1)  # bin b: cuts[b-1] < x <= cuts[b]
    draw = np.random.default_rng(seed)
    margin = np.zeros(len(rows))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        chance = _chance(margin)
        slope, bend = weights * (labels - chance), weights * chance * (1 - chance)
        usable = sorted(draw.permutation(rows.shape[1])[: -(-rows.shape[1] // 2)].tolist())
        nodes = [(np.arange(len(rows)), {})]
        for level in range(DEPTH + 1):
            deeper = []
            for inside, bounds in nodes:
                best = None
                if level < DEPTH:
                    for i in usable:
                        sums = [np.cumsum(np.bincount(bins[inside, i], w, len(cuts[i]) + 1))[:-1] for w in (slope[inside], bend[inside], None)]
                        (g, h, n), (gs, hs) = sums, (slope[inside].sum(), bend[inside].sum())
                        gain = g**2 / (h + 1) + (gs - g) ** 2 / (hs - h + 1) - gs**2 / (hs + 1)
                        gain[(n < LEAF_ROWS) | (len(inside) - n < LEAF_ROWS)] = 0
                        if len(gain) and (best is None or gain.max() > best[0]):
                            best = (gain.max(), i, int(gain.argmax()))
                if best is None or best[0] <= 1e-6:
                    margin[inside] += RATE * slope[inside].sum() / (bend[inside].sum() + 1)
                    continue
                _, i, at = best
                low, high = bounds.get(i, (-np.inf, np.inf))
                left = bins[inside, i] <= at
                cut = float(cuts[i][at])
                for part, limits in ((inside[left], (low, cut)), (inside[~left], (cut, high))):
                    path = bounds | {i: limits}
                    found[Rule(tuple((k, *path[k]) for k in sorted(path)))] = None
                    deeper.append((part, path))
            nodes = deeper
    return list(found)


def lasso_weights(
    covered: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float, start: np.ndarray
) -> np.ndarray:
    """Logistic weights with an absolute penalty, by accelerated proximal steps; the first weight, the bias, is free."""
    step = 4 / max(np.linalg.norm(covered * np.sqrt(weights)[:, None], 2) ** 2, 1e-12)
    now, ahead, pace = start.copy(), start.copy(), 1.0
    for _ in range(ROUNDS):
        new = ahead + step * (covered.T @ (weights * (labels - _chance(covered @ ahead))))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        quicker = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        now, ahead, pace = new, new + (pace - 1) / quicker * (new - now), quicker
    return now


def _loss(covered: np.ndarray, labels: np.ndarray, weights: np.ndarray, w: np.ndarray) -> float:
    margin = covered @ w
    return float((weights * (np.logaddexp(0, margin) - labels * margin)).sum() / weights.sum())


def fit(rows: np.ndarray, labels: np.ndarray, shares: tuple[float, float] = (0.5, 0.5)) -> RuleModel:
    """Rules and weights from statistics and labels; ``shares`` are those of the classes in all labelled documents.

    Every fifth row is kept aside to choose the penalty: the strongest whose loss is within two per cent of the least. With
    one class only there are no rules, and every text scores the share of good ones.
    """
    have = np.array([max((labels == y).sum(), 1) for y in (0, 1)])
    weights = (np.array(shares) / have)[labels.astype(int)] if len(labels) else np.zeros(0)
    good = min(max(shares[1] / max(sum(shares), 1e-12), 1e-4), 1 - 1e-4)
    empty = RuleModel([], [], float(np.log(good / (1 - good))))
    if len(set(labels.tolist())) < 2:
        return empty
    weights = weights / weights.sum()
    aside = np.arange(len(rows)) % 5 == 4
    rules = tree_rules(rows[~aside], labels[~aside], weights[~aside] * (~aside).sum())
    covered = {r.covers(rows).tobytes(): r for r in reversed(rules)}  # of rules that cover the same rows the first
    rules = list(covered.values())
    table = np.stack([np.ones(len(rows)), *(r.covers(rows) for r in rules)], axis=1).astype(np.float64)
    w = np.zeros(table.shape[1])
    w[0] = empty.bias
    tried = []
    for penalty in PENALTIES:
        w = lasso_weights(table[~aside], labels[~aside], weights[~aside] / weights[~aside].sum(), penalty, w)
        tried.append((w, _loss(table[aside], labels[aside], weights[aside], w) if aside.any() else 0.0))
    least = min(loss for _, loss in tried)
    w = next(w for w, loss in tried if loss <= 1.02 * least + 1e-4)
    kept = [i for i in range(len(rules)) if abs(w[i + 1]) > 1e-9]
    return RuleModel([rules[i] for i in kept], [float(w[i + 1]) for i in kept], float(w[0]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by three."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on at most ``TRAIN_PER_CLASS`` labelled documents of each class that are not held out, drawn by a hash of the id.

    Labels are first restricted to ids that have a document, by the id columns alone; the drawn ids are broadcast to find
    their texts, which are measured where they lie. Only the statistics come to the driver. An id's label is 1 if all its
    labels are; labels other than 0 and 1 and null ids are ignored. A repeated id counts with one of its texts.
    """
    marks = pick(labels, _id=id_col, _label=label_col)
    marks = marks.where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    marks = marks.groupBy("_id").agg(F.min("_label").cast("int").alias("_label"))
    rows = pick(docs, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    marks = stage(marks.join(rows.select("_id"), "_id", "left_semi").withColumn("_order", F.xxhash64(F.col("_id").cast("string"))))
    have = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    drawn = [marks.where(F.col("_label") == y).orderBy("_order", "_id").limit(TRAIN_PER_CLASS) for y in (0, 1)]
    drawn = stage(drawn[0].unionByName(drawn[1]))
    texts = rows.join(F.broadcast(drawn), "_id").select("_id", "_order", "_label", "_text")
    found = _measured(texts, "_text").groupBy("_order", "_id", "_label").agg(F.min("_stats").alias("_stats"))
    sample = found.orderBy("_order", "_id").select("_label", "_stats").collect()
    stats = np.array([r["_stats"] for r in sample]).reshape(len(sample), len(STATISTICS))
    total = max(sum(have.values()), 1)
    return fit(stats, np.array([r["_label"] for r in sample], np.int64), (have.get(0, 0) / total, have.get(1, 0) / total))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (0 to 1, higher: better text), an expression over the statistics of the whole text.

    Rows are measured where they are, without a shuffle. Null and empty texts have statistics of 0 and are scored by them.
    Other columns pass through; a ``_score`` is replaced.
    """
    names = docs.columns
    at = names.index(text_col)
    docs = shielded(docs)
    measured = _measured(docs.withColumn(f"in{at}", F.col(f"in{at}").cast("string")), f"in{at}")
    return unshielded(measured.withColumn("_score", model.column(F.col("_stats"))), names, ["_score"])
