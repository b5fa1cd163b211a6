"""Line deduplication: drop lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm.common import document_key, shielded, small, stage, unshielded, with_fields

# Fixed value: the characters stripped from both ends of a line, [\x20\x09-\x0D].
LINE_SPACE = b" \t\n\x0b\x0c\r"


def _keyed_lines(text: str | None) -> list[tuple[str, bytes]]:
    """The lines of a text with the normalised key of each (UTF-8; only A-Z are lower-cased)."""
    lines = (text or "").split("\n")
    return [(line, line.encode("utf-8", "surrogatepass").strip(LINE_SPACE).lower()) for line in lines]


def _has_chars(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {xxhash.xxh3_128_digest(k) for _, k in _keyed_lines(text) if _has_chars(k, min_chars)}
            keys.extend([doc] * len(found))
            hashes.extend(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.binary())], ["_doc", "_line"])


def _drop_lines(batches: Iterator[pa.RecordBatch], text_at: int, drops_at: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, drops in zip(batch.column(text_at).to_pylist(), batch.column(drops_at).to_pylist()):
            lines = _keyed_lines(text)
            if drops:
                gone = set(drops)
                stay = [
                    line
                    for line, key in lines
                    if not (_has_chars(key, min_chars) and xxhash.xxh3_128_digest(key) in gone)
                ]
            else:
                stay = [line for line, _ in lines]
            kept.append("\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        columns = batch.columns[:drops_at]
        columns[text_at] = pa.array(kept, pa.string())
        names = batch.schema.names[:drops_at]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"]
        )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10
) -> DataFrame:
    """The documents with ``text_col`` rid of lines that at least ``min_docs`` documents hold, plus ``_n_lines`` (before)
    and ``_n_dropped``. A line's key is the line stripped of ``LINE_SPACE`` with A-Z lower-cased; keys of fewer than
    ``min_chars`` code points always stay.

    Every task hashes the lines of its documents (128 bits), one row per document and key. The document count of a key
    is a two-step count, (key, document) and then key, so a line in every document is summed from partial counts.
    Frequent keys are sent to every task if they are counted to be few, so their rows stay where they lie; otherwise the
    two are joined by key and Spark splits skewed partitions. Only (document, key) rows of frequent keys come back; they meet the texts by document, never by line, so the one
    join of texts is on an even key.

    Null and empty texts are one empty line; their text becomes empty. Rows that repeat an id are one document for the
    counts and each keep their own row. Rows without an id are told apart by their text. Other columns pass through; one
    that has the name of an added column is replaced.
    """
    names = docs.columns
    id_col, text_col = (f"in{names.index(c)}" for c in (id_col, text_col))
    docs = shielded(docs)
    columns = docs.columns
    docs = docs.withColumn("_doc", document_key(id_col, text_col))
    keys = docs.select("_doc", F.col(text_col).cast("string").alias("_text"))
    pairs = stage(keys.mapInArrow(partial(_hash_lines, min_chars=min_chars), "_doc string, _line binary").distinct())
    frequent = stage(pairs.groupBy("_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).select("_line"))
    drops = pairs.join(small(frequent), "_line").groupBy("_doc").agg(F.collect_set("_line").alias("_drops"))
    joined = docs.join(drops, "_doc", "left").select(*columns, "_drops").withColumn(text_col, F.col(text_col).cast("string"))
    plain = docs.select(*columns).withColumn(text_col, F.lit("")).schema
    out = with_fields(plain, _n_lines=T.LongType(), _n_dropped=T.LongType())
    drop = partial(_drop_lines, text_at=columns.index(text_col), drops_at=len(columns), min_chars=min_chars)
    return unshielded(joined.mapInArrow(drop, out), names, ["_n_lines", "_n_dropped"])
