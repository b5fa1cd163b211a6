"""Token layout, user token streams and the table of valid prefixes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.functions.scalars import pad_right
from reckoner.operators.ordering import newest
from reckoner.operators.semantic_ids import level_columns
from reckoner.operators.sequences import SEQ_ORDER

# Fixed value: codes per level in the token layout.
LEVEL_SIZE = 256


@dataclass(frozen=True)
class Vocabulary:
    """Layout ``[level 1][level 2]...[dedup][user buckets][PAD]``."""

    levels: int
    dedup_size: int
    user_buckets: int = 0
    max_items: int = 10
    level_size: int = LEVEL_SIZE

    @property
    def item_vocab(self) -> int:
        return self.levels * self.level_size + self.dedup_size

    @property
    def pad(self) -> int:
        return self.item_vocab + self.user_buckets

    @property
    def digits(self) -> int:
        return self.levels + 1

    @property
    def max_len(self) -> int:
        return self.max_items * self.digits + (1 if self.user_buckets else 0)

    @property
    def context_items(self) -> int:
        """Items that fit into a decoding context when one item's digits are still to be generated."""
        return (self.max_len - (1 if self.user_buckets else 0)) // self.digits - 1

    def as_row(self) -> dict:
        return asdict(self) | {"item_vocab": self.item_vocab, "pad": self.pad, "vocab_size": self.pad + 1, "max_len": self.max_len}


def vocabulary_for(sids: DataFrame, **options) -> Vocabulary:
    """Layout with the dedup range taken from the data."""
    top = sids.agg(F.max("sid_dedup").alias("d")).first()["d"]
    return Vocabulary(levels=len(level_columns(sids)), dedup_size=int(top or 0) + 1, **options)


def vocabulary_table(spark, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame([tuple(vocabulary.as_row().values())], list(vocabulary.as_row()))


def item_tokens(sids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(item_id, tok1..tokL, tok{L+1})``; a code or dedup digit outside its range raises."""
    columns = []
    for i, c in enumerate(level_columns(sids)):
        columns.append(_in_range(F.col(c), vocabulary.level_size, c, i * vocabulary.level_size).alias(f"tok{i + 1}"))
    base = vocabulary.levels * vocabulary.level_size
    columns.append(_in_range(F.col("sid_dedup"), vocabulary.dedup_size, "sid_dedup", base).alias(f"tok{vocabulary.digits}"))
    return sids.select("item_id", *columns)


def _in_range(value: Column, size: int, name: str, base: int) -> Column:
    fits = (value >= 0) & (value < size)
    return F.when(fits, value + base).otherwise(F.raise_error(F.lit(f"{name} outside 0..{size - 1}"))).cast("int")


def user_bucket_token(user: Column, vocabulary: Vocabulary) -> Column:
    return (F.lit(vocabulary.item_vocab) + F.pmod(user, F.lit(vocabulary.user_buckets))).cast("int")


def token_streams(history: DataFrame, tokens: DataFrame, vocabulary: Vocabulary, max_items: int | None = None, pad: bool = True) -> DataFrame:
    """``(user_id, tokens, length)``: the newest items' digits in time order, user token first, right-padded.

    At most ``max_items`` rows per user enter the list, counted among the items that have tokens; the limit runs before
    the shuffle by user.
    """
    n = vocabulary.max_items if max_items is None else max_items
    digits = F.array(*[F.col(f"tok{i + 1}") for i in range(vocabulary.digits)])
    known = history.select("user_id", *SEQ_ORDER).join(tokens.select("item_id", digits.alias("digits")), "item_id")
    joined = newest(known, "user_id", SEQ_ORDER, n).select("user_id", (-F.col("age")).alias("o"), "digits")
    rows = F.array_sort(F.collect_list(F.struct("o", "digits")))
    streams = joined.groupBy("user_id").agg(F.flatten(F.transform(rows, lambda r: r["digits"])).alias("tokens"))
    if vocabulary.user_buckets:
        streams = streams.withColumn("tokens", F.concat(F.array(user_bucket_token(F.col("user_id"), vocabulary)), F.col("tokens")))
    streams = streams.withColumn("length", F.size("tokens"))
    if not pad:
        return streams
    width = n * vocabulary.digits + (1 if vocabulary.user_buckets else 0)
    return streams.withColumn("tokens", pad_right(F.col("tokens"), width, vocabulary.pad))


def decoding_contexts(history: DataFrame, tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Unpadded newest context that leaves room for one generated item."""
    return token_streams(history, tokens, vocabulary, vocabulary.context_items, pad=False)


def length_statistics(streams: DataFrame) -> DataFrame:
    return streams.agg(
        F.min("length").alias("min_len"),
        F.median("length").alias("median_len"),
        F.avg("length").alias("mean_len"),
        F.max("length").alias("max_len"),
    )


def prefix_of(depth: int) -> Column:
    """Text key of the first ``depth`` tokens; the root is the empty text."""
    return F.concat_ws("-", *[F.col(f"tok{i + 1}").cast("string") for i in range(depth)]) if depth else F.lit("")


def prefix_table(tokens: DataFrame, digits: int) -> DataFrame:
    """``(depth, prefix, token, n_items, item_id)``: every valid continuation; ``item_id`` is set on the leaves."""
    out = None
    for depth in range(digits):
        leaf = F.min("item_id") if depth == digits - 1 else F.lit(None).cast("long")
        level = (
            tokens.groupBy(prefix_of(depth).alias("prefix"), F.col(f"tok{depth + 1}").alias("token"))
            .agg(F.count("*").alias("n_items"), leaf.alias("item_id"))
            .select(F.lit(depth).alias("depth"), "prefix", "token", "n_items", "item_id")
        )
        out = level if out is None else out.unionByName(level)
    return out
