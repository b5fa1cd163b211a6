"""Composing recommendation lists: unseen top-K from ranked lists, fallback, seen filters, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckoner.operators.ordering import durable

RANK_BLOCK = 4096  # ranks of one list that a task counts for one user


def top_unseen(users: DataFrame, lists: DataFrame, seen: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """The first ``k`` entries of each user's list that the user has not seen. Exact, without a cross join.

    ``users(user_id, list_id)`` names the list of every user, ``lists(list_id, rank, item_id, score)`` holds the
    lists with ranks 1..n, ``seen(user_id, item_id)`` are distinct pairs.

    The first ``depth`` ranks (``4 * k`` unless given) of the lists are staged. Seen pairs that lie there give each user's seen
    ranks, at most ``depth`` of them, and the unseen ranks are what they leave of 1, 2, ... Users with fewer than ``k`` unseen
    entries there, and a list that goes on, are served by ``unseen_entries`` from the whole lists. All others need neither the
    rest of the lists nor the seen pairs outside, and the staged table has its true size, so that joins with it need no shuffle
    of a few hot ranks.
    """
    depth = depth or 4 * k
    heads = durable(lists.where(F.col("rank") <= depth + 1).select("list_id", F.col("rank").cast("long").alias("rank"), "item_id", "score"))
    longer = heads.where(F.col("rank") > depth).select("list_id")
    heads = heads.where(F.col("rank") <= depth)
    users = users.select("user_id", "list_id").distinct()
    near = seen.select("user_id", "item_id").join(heads.select("item_id").distinct(), "item_id", "left_semi")
    marks = near.join(users, "user_id").join(heads.select("list_id", "item_id", "rank"), ["list_id", "item_id"])
    marks = durable(marks.groupBy("user_id", "list_id").agg(F.collect_set("rank").alias("_ranks")))
    short = marks.where(F.size("_ranks") > depth - k).join(longer, "list_id", "left_semi").select("user_id", "list_id")
    rest = durable(short) if not longer.isEmpty() else None
    if rest is not None and rest.isEmpty():
        rest = None
    near_users = users if rest is None else users.join(rest, ["user_id", "list_id"], "left_anti")
    met = F.coalesce("_ranks", F.array().cast("array<bigint>"))
    unseen = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.lit(k) + F.size(met)), met), 1, k)
    wanted = near_users.join(marks, ["user_id", "list_id"], "left").select("user_id", "list_id", F.posexplode(unseen).alias("_place", "rank"))
    found = wanted.join(heads, ["list_id", "rank"]).select("user_id", "item_id", "score", (F.col("_place") + 1).alias("rank"))
    if rest is None:
        return found
    theirs = seen.join(rest.select("user_id").distinct(), "user_id", "left_semi")
    return found.unionByName(unseen_entries(rest, lists, theirs, k).drop("list_id"))


def seen_before(marks: DataFrame, k: int, block: int = RANK_BLOCK) -> DataFrame:
    """Add ``_before``, how many seen ranks of the (user, list) are smaller, to ``marks(user_id, list_id, rank)``.

    A running count in two steps: seen ranks per block of the list, then ranks within a block. A user who has seen a third
    of everything is spread over as many groups as their lists have blocks. Blocks that begin after ``k`` unseen entries
    cannot matter and are left out.
    """
    keys = ["user_id", "list_id"]
    marks = marks.withColumn("_block", F.floor((F.col("rank") - 1) / block))
    sizes = marks.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    needed = sizes.where(F.col("_block") * block - F.col("_earlier") < k).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("rank")) - 1
    placed = marks.withColumn("_within", within).join(needed, [*keys, "_block"])
    return placed.select(*keys, "rank", (F.col("_earlier") + F.col("_within")).alias("_before"))


def unseen_entries(users: DataFrame, lists: DataFrame, seen: DataFrame, k: int, block: int = RANK_BLOCK) -> DataFrame:
    """``top_unseen`` from the whole lists, also for users with several of them: one block of ranks per (user, list).

    Before the j-th seen rank there are ``rank - j`` unseen entries, so the unseen ranks follow from the seen ones, and
    only the ``k`` ranks that survive are generated and looked up. Work is linear in (seen pairs + users * k).
    """
    users = users.select("user_id", "list_id")
    places = lists.select("list_id", "item_id", "rank")
    hits = seen.select("user_id", "item_id").join(users, "user_id").join(places, ["list_id", "item_id"])
    marks = hits.select("user_id", "list_id", F.col("rank").cast("long").alias("rank"))

    # After _unseen unseen entries the list has _seen seen ones: at most k such steps per (user, list).
    steps = seen_before(marks, k, block).select(
        "user_id", "list_id", (F.col("rank") - 1 - F.col("_before")).alias("_unseen"), (F.col("_before") + 1).alias("_seen")
    )
    starts = users.select("user_id", "list_id", F.lit(0).cast("long").alias("_unseen"), F.lit(0).cast("long").alias("_seen"))
    steps = steps.where(F.col("_unseen") < k).unionByName(starts)
    steps = steps.groupBy("user_id", "list_id", "_unseen").agg(F.max("_seen").alias("_seen"))
    by_step = Window.partitionBy("user_id", "list_id").orderBy("_unseen")
    steps = steps.withColumn("_next", F.lead("_unseen", 1, k).over(by_step))
    wanted = steps.select("user_id", "list_id", "_seen", F.explode(F.sequence(F.col("_unseen") + 1, F.col("_next"))).alias("_place"))
    wanted = wanted.withColumn("_list_rank", F.col("_place") + F.col("_seen"))
    entries = lists.select("list_id", F.col("rank").cast("long").alias("_list_rank"), "item_id", "score")
    return wanted.join(entries, ["list_id", "_list_rank"]).select(
        "user_id", "list_id", "item_id", "score", F.col("_place").cast("int").alias("rank")
    )


def ranked(scored: DataFrame, k: int | None = None, score: str = "score", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rank by score, item id on ties. With ``k`` the row limit also runs before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("item_id"))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def drop_seen(recs: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Remove seen pairs and close the gaps in the ranks; the order is kept."""
    left = recs.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("rank")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_fallback(recs: DataFrame, fallback: DataFrame) -> DataFrame:
    """Users without any row in ``recs`` get their ``fallback`` list."""
    served = recs.select("user_id").distinct()
    columns = ["user_id", "item_id", "score", "rank"]
    return recs.select(*columns).unionByName(fallback.join(served, "user_id", "left_anti").select(*columns))


def filled_up(recs: DataFrame, filler: DataFrame, k: int) -> DataFrame:
    """Short lists are completed from ``filler`` (at least k entries per user) without repeating an item.

    Filler scores are kept; filler entries always follow the user's own entries.
    """
    own = recs.select("user_id", "item_id", "score", "rank", F.lit(0).alias("_tier"))
    rest = filler.select("user_id", "item_id", "score", "rank", F.lit(1).alias("_tier"))
    both = own.unionByName(rest).groupBy("user_id", "item_id").agg(F.min_by(F.struct("score", "rank", "_tier"), F.struct("_tier", "rank")).alias("e"))
    order = Window.partitionBy("user_id").orderBy("e._tier", "e.rank")
    placed = both.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return placed.select("user_id", "item_id", F.col("e.score").alias("score"), F.col("_place").alias("rank"))


def short_lists(recs: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Users left with fewer than ``k`` entries, and how many they have."""
    n = recs.groupBy("user_id").agg(F.count("*").alias("n_recs"))
    joined = users.select("user_id").join(n, "user_id", "left").withColumn("n_recs", F.coalesce("n_recs", F.lit(0)))
    return joined.where(F.col("n_recs") < k)


def log_softmax(recs: DataFrame, score: str = "score", out: str = "log_prob") -> DataFrame:
    """``score - logsumexp`` per user over the user's (bounded) candidate list."""
    per_user = Window.partitionBy("user_id")
    shifted = recs.withColumn("_max", F.max(score).over(per_user))
    total = F.sum(F.exp(F.col(score) - F.col("_max"))).over(per_user)
    return shifted.withColumn(out, F.col(score) - (F.col("_max") + F.ln(total))).drop("_max")


def with_titles(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    return recs.join(catalog.select("item_id", "description"), "item_id", "left")


def side_by_side(tiers: dict[str, DataFrame], targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lists of several models in one table with titles and a hit marker per entry."""
    union = None
    for model, recs in tiers.items():
        part = recs.select(F.lit(model).alias("model"), "user_id", "item_id", "rank")
        union = part if union is None else union.unionByName(part)
    marked = targets.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    joined = union.join(marked, ["user_id", "item_id"], "left")
    return with_titles(joined.withColumn("hit", F.coalesce("_hit", F.lit(0))).drop("_hit"), catalog)


def hit_ranks(listing: DataFrame) -> DataFrame:
    """Best rank of a hit per user and model, null without a hit."""
    best: Column = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    return listing.groupBy("user_id", "model").agg(best.alias("hit_rank"), F.count("*").alias("n_recs"))
