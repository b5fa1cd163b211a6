"""A cleaning and packing pipeline over ``documents``.

Five stages, each one operator of ``reckoner.llm`` over everything its predecessor kept. Every stage is written as Parquet
to the cluster's shared folder and read again, so a lost executor costs a part of one stage. All stages but the last return
the columns of ``documents``; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path
from reckoner.llm import line_dedup, mixing, ngram_jaccard, packing, toxicity
from reckoner.llm.catalogue import TOKENIZER
from reckoner.llm.common import prepared, shielded, stage, table


def _own(docs: DataFrame, name: str) -> str:
    """The shielded name of a column."""
    return f"in{docs.columns.index(name)}"


def _restored(shielded_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever they are called, without those that an operator added."""
    return shielded_docs.select(*[f"in{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below one half.

    The network is fitted on labelled rows of ``documents`` that are not held out. Null and empty texts are not toxic.
    """
    prepared(spark)
    network = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(shielded(docs), network, _own(docs, "text"))
    words = F.coalesce(F.col(_own(docs, "text")), F.lit("")).rlike(r"[\p{L}\p{N}]")
    return _restored(scored.where((F.col("_score") < 0.5) | ~words), docs)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; ``n_chars``, where there is one, follows the text. No row goes."""
    prepared(spark)
    text = _own(docs, "text")
    kept = line_dedup.line_dedup(shielded(docs), _own(docs, "doc_id"), text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn(_own(docs, "n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType))
    return _restored(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near-duplicates; texts without words all stay."""
    prepared(spark)
    found = ngram_jaccard.near_duplicates(shielded(docs), _own(docs, "doc_id"), _own(docs, "text"))
    return _restored(found.where("_kept"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come to their target weights (square root of their text), in shuffled order."""
    prepared(spark)
    mixed = mixing.mix_sources(shielded(docs), *(_own(docs, c) for c in ("doc_id", "text", "source")))
    return _restored(mixed, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, one row each; copies of a document are packed like other documents."""
    prepared(spark)
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_frequent_lines),
    ("n-gram jaccard", drop_near_duplicates),
    ("source mixing", mix),
    ("packing", pack),
]

# The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
