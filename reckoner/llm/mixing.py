"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import shielded, small, stage, unshielded

# exp(-mean) must not underflow: a larger mean is the sum of this many-at-most independent draws.
MEAN_PER_DRAW = 500.0


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts: the same in every run and on every machine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, far enough that what is left is below the resolution of the draw."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct(
            (acc.p * mean / k).alias("p"),
            F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * mean / k)).alias("cdf"),
        ),
    )
    return grown["cdf"]


def source_rates(docs: DataFrame, targets: dict[str, float] | None, power: float, total: float | None) -> DataFrame:
    """Per source ``_source``, ``rate`` (mean copies of a document), ``draws`` and the ``cdf`` of one draw.

    The size of a source is its characters. ``targets`` gives weights by source (0 when not named); without it the
    weight is size ** ``power``. ``total`` is the wanted number of documents' worth of text, by default what there is.
    """
    length = F.greatest(F.length(F.coalesce(F.col("_text"), F.lit(""))), F.lit(1)).cast("long")
    sizes = docs.groupBy("_source").agg(F.sum(length).alias("_size"), F.count("*").alias("_rows"))
    if targets is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(power)))
    else:
        pairs = [F.when(F.col("_source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in targets.items()]
        weight = F.coalesce(*pairs, F.lit(0.0))
    sizes = stage(sizes.withColumn("_weight", weight))
    sums = sizes.agg(F.sum("_weight").alias("w"), F.sum("_size").alias("s"), F.sum("_rows").alias("n"))
    scale = F.lit(1.0) if total is None else F.lit(float(total)) / sums.select("n").scalar()
    whole = sums.select("s").scalar() * scale
    weights = sums.select("w").scalar()
    rate = F.when(weights > 0, F.col("_weight") / weights * whole / F.col("_size")).otherwise(F.lit(0.0))
    rates = sizes.select("_source", rate.alias("rate"))
    draws = F.greatest(F.ceil(F.col("rate") / MEAN_PER_DRAW), F.lit(1)).cast("int")
    rates = rates.withColumn("draws", draws)
    return stage(rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws"))))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Repeat every document a Poisson number of times so that sources reach their target weights, in shuffled order.

    The number of copies inverts the Poisson distribution whose mean is the source's target repetition rate, at a
    uniform hashed from seed and id. Adds ``_copy`` (0, 1, ...), ``_rate`` and ``_order``, the hex key of the global
    order: rows are dealt to partitions by that key and sorted by it inside, which is a uniform permutation in one pass.
    Rates are a table with a row per source; it is broadcast only when counted small, else joined by source with the
    adaptive split of the large source. Dealing goes by (id, copy), so a source of any size is spread.

    A null source is a source of its own. Rows with equal ids get equal counts; a null id counts as an empty string.
    An empty table gives an empty table. Empty texts weigh one character. Other columns pass through; one that has the name
    of an added column is replaced.
    """
    names = docs.columns
    id_col, text_col, source_col = (f"in{names.index(c)}" for c in (id_col, text_col, source_col))
    docs = shielded(docs)
    columns = docs.columns
    rows = docs.withColumns({"_source": F.col(source_col).cast("string"), "_text": F.col(text_col).cast("string")})
    rates = source_rates(rows.select("_source", "_text"), targets, power, total)
    rates = rates.select(F.col("_source").alias("_s"), "rate", "draws", "cdf")
    known = rows.join(small(rates), F.col("_source").eqNullSafe(F.col("_s")))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: hashed_uniform(F.lit(str(seed)), key, j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda p: u >= p)))
    known = known.withColumn("_copies", copies).where(F.col("_copies") > 0)
    copy = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")
    dealt = known.select(*columns, copy, F.col("rate").alias("_rate"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed} order"), key, F.col("_copy").cast("string")))
    dealt = dealt.withColumn("_order", order)
    dealt = dealt.repartition(F.col("_order")).sortWithinPartitions("_order")
    return unshielded(dealt, names, ["_copy", "_rate", "_order"])
