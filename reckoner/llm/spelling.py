"""Spelling variants: words that differ by one letter, found over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm.common import pick, stage

# Symbols of the reduced alphabet. More symbols mean more neighbours of a word and fewer words that share one.
SYMBOLS = 8
# Letters are dealt to the symbols in a drawn order, equally many to each.
_SYMBOL_OF = np.random.default_rng(12).permutation(0x100) % SYMBOLS

# Bits of the map of reduced words that every task holds: 8 MB whatever the vocabulary.
_MAP_BITS = 1 << 26
# Distinct words a task counts before it hands them on, and neighbours it generates at once.
_HELD_WORDS, _HELD_KEYS = 200_000, 2_000_000

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # [A-Za-zÀ-ÿ]+ in UTF-8, lower-cased
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def _chars(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def _without(word: bytes, at: int) -> bytes:
    text = word.decode("utf-8")
    return (text[:at] + text[at + 1 :]).encode("utf-8")


def _count_runs(batches: Iterator[pa.RecordBatch], min_chars: int, noise: int | None) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        out = [pa.array([w.decode("utf-8") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(out, ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode("utf-8", "surrogatepass"))
            for run, n in Counter(_RUN.findall((text or "").encode("utf-8", "surrogatepass").lower())).items():
                if len(run) < min_chars:
                    continue
                if noise and not (h := zlib.crc32(run, start)) % noise:
                    run = _without(run, h % _chars(run))
                if _chars(run) >= min_chars:
                    found[run] += n
            if len(found) >= _HELD_WORDS:
                yield rows()
    yield rows()


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, noise: int | None = None
) -> DataFrame:
    """Words (``word``, ``n``) of at least ``min_chars`` letters that occur at least ``min_count`` times in all texts.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. With ``noise``, a run whose crc32 together
    with its document's id (of UTF-8 ``<id>:<run>``) is a multiple of ``noise`` loses one letter, that of the crc32 modulo
    its length: planted misspellings that every run makes alike. Null texts have no words, a null id is the empty text,
    and repeated rows count each. Tasks count their own words first, so a frequent word is a few rows per task.
    """
    texts = pick(docs, _id=id_col, _text=text_col).select(F.col("_id").cast("string"), F.col("_text").cast("string"))
    counted = texts.mapInArrow(partial(_count_runs, min_chars=min_chars, noise=noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and reduced letters of the words of each length, in groups of bounded size."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        some = max(1, _HELD_KEYS // max(1, 2 * SYMBOLS * (length + 1)))
        for i in range(0, len(rows), some):
            part = rows[i : i + some]
            codes = np.frombuffer("".join(words[r] for r in part).encode("utf-32-le"), dtype="<u4")
            yield part, _SYMBOL_OF[codes & 0xFF].reshape(len(part), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length, _FACTOR), dtype=np.uint64)])


def _sums(symbols: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes; the last column is that of the whole reduced words. A symbol counts as one to SYMBOLS."""
    terms = (symbols + np.uint64(1)) * powers[: symbols.shape[1]]
    return np.concatenate([np.zeros((len(symbols), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def reduced_keys(words: list[str]) -> np.ndarray:
    """The hash of each word's letters over the reduced alphabet."""
    keys = np.zeros(len(words), np.uint64)
    for rows, symbols in _by_length(words):
        keys[rows] = _sums(symbols, _powers(symbols.shape[1]))[:, -1]
    return keys


def neighbour_keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words and hashes of reduced words: each word's own and all that are one edit from it, each once."""
    for rows, symbols in _by_length(words):
        count, length = symbols.shape
        powers = _powers(length + 1)
        prefix = _sums(symbols, powers)
        whole = prefix[:, -1:]
        rest = whole - prefix
        same = np.concatenate([np.zeros((count, 1), bool), symbols[:, 1:] == symbols[:, :-1]], axis=1)
        deleted = prefix[:, :-1] + rest[:, 1:] * _INVERSE
        before = np.concatenate([np.full((count, 1), SYMBOLS, np.uint64), symbols], axis=1)
        found = [(whole, np.ones((count, 1), bool)), (deleted, ~same)]  # of a run of equal symbols only the first goes
        for c in np.arange(SYMBOLS, dtype=np.uint64):
            found.append((whole + (c - symbols) * powers[:length], symbols != c))
            found.append((prefix + (c + np.uint64(1)) * powers[: length + 1] + rest * _FACTOR, before != c))
        keys, kept = (np.concatenate(x, axis=1) for x in zip(*found))
        yield np.repeat(rows, kept.sum(axis=1)), keys[kept]


def _place(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(38)).astype(np.int64)


def _add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = reduced_keys(batch.column(0).to_pylist())
        added = [pa.array(keys.view(np.int64)), pa.array(_place(keys))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_key", "_place"])


def _neighbours(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(known.value, np.uint8)
    for batch in batches:
        words = batch.column(0)
        for rows, keys in neighbour_keys(words.to_pylist()):
            place = _place(keys)
            there = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([words.take(pa.array(rows[there])), pa.array(keys[there].view(np.int64))], ["word", "_key"])


def _map_of(spark: SparkSession, keyed: DataFrame) -> Broadcast:
    """A bit for every hash place that a reduced word of the vocabulary has. Its size is fixed; tasks set the bits."""
    bucket, bit = F.shiftright("_place", 15), F.col("_place").bitwiseAND(F.lit((1 << 15) - 1))
    parts = keyed.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    bits = bytearray(_MAP_BITS // 8)
    for row in parts.toLocalIterator():
        bits[row["_bucket"] << 12 : (row["_bucket"] + 1) << 12] = row["_bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs (``word``, ``near``, ``near_n``) of words that one inserted, deleted or replaced letter makes equal.

    Letters are hashed to ``SYMBOLS`` symbols. Two words one edit apart have reduced words at most one edit apart, so every
    word generates all reduced words within one edit and meets the words reduced to one of them; each pair is met once
    in either direction and then compared letter by letter. A map of fixed size holds which reduced words there are, so
    few of the generated ones are shuffled. Crowded reduced words are split by Spark's skew join.
    """
    keyed = stage(words.mapInArrow(_add_keys, "word string, n long, _key long, _place long"))
    known = _map_of(words.sparkSession, keyed.select("_place"))
    sought = keyed.select("word").mapInArrow(partial(_neighbours, known=known), "word string, _key long")
    there = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "_key")
    one_edit = F.levenshtein("word", "near", 1) == 1
    close = F.abs(F.length("word") - F.length("near")) <= 1
    return sought.join(there, "_key").where((F.col("word") != F.col("near")) & close & one_edit).select("word", "near", "near_n")


def _followed(links: DataFrame) -> DataFrame:
    """The last form each linked word leads to. A form is several times as frequent as its word, so chains are short and
    end; each round doubles the steps that are known."""
    links = stage(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stage(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        links = longer.select("word", "root")
        if longer.where("_next IS NOT NULL").isEmpty():
            return links


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``words`` (``word``, ``n``; each word once) with ``n_near`` (words one letter away), ``form``, ``form_n`` and ``root``.

    A word's form is its most frequent near word (ties: the first in code-point order), if that one is at least ``ratio``
    times as frequent; else null. ``root`` follows forms to the last and is the word itself where there is none. Words in
    an empty table have no rows. ``ratio`` must be 2 or more.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead to ever more frequent words")
    words = stage(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("_best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.near").alias("form"), (-F.col("_best.m")).alias("form_n")
    )
    fits = F.col("form_n") >= ratio * F.col("n")
    found = stage(found.withColumn("form", F.when(fits, F.col("form"))).withColumn("form_n", F.when(fits, F.col("form_n"))))
    roots = _followed(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
