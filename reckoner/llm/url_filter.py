"""URL filter: host and path rules first, then a weighted vocabulary counted with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import pick

# Own lists. One strict term rejects a url; soft terms reject when there are SOFT_DISTINCT different ones and their weights
# reach SOFT_LIMIT.
STRICT_TERMS = ("adult", "bets", "betting", "casino", "escort", "gambling", "hentai", "jackpot", "nude", "porn", "porno",
                "poker", "sex", "slots", "viagra", "warez", "xxx")
SOFT_TERMS = {
    "ads": 1, "affiliate": 1, "bonus": 1, "cheap": 1, "click": 1, "coupon": 1, "crack": 1, "deals": 1, "farm": 1,
    "free": 1, "keygen": 2, "loan": 1, "lottery": 2, "mirror": 1, "pills": 2, "prize": 1, "promo": 1, "proxy": 1,
    "spam": 2, "torrent": 1, "track": 1, "tracker": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT, SOFT_DISTINCT = 2, 2

# Fixed values of the contract: (verdict, rule); a rule is a host, then the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOUND = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null. A rule's host covers its subdomains."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, hit) if cases is None else cases.when(fits, hit)
    return cases


def _automaton(strict, soft) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in strict:
        found.add_word(term, (term, None))
    for term, weight in soft.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _count_terms(batches: Iterator[pa.RecordBatch], url_at: int, strict, soft) -> Iterator[pa.RecordBatch]:
    lower = str.maketrans(_UPPER, _LOWER)
    automaton = _automaton(strict, soft)
    for batch in batches:
        columns = ([], [], [])
        for url in batch.column(url_at).to_pylist():
            url = (url or "").translate(lower)
            strict_hits, soft_hits = set(), {}
            for end, (term, weight) in automaton.iter(url):
                start = end - len(term) + 1
                if (start and url[start - 1] in _BOUND) or (end + 1 < len(url) and url[end + 1] in _BOUND):
                    continue
                if weight is None:
                    strict_hits.add(term)
                else:
                    soft_hits[term] = weight
            for column, value in zip(columns, (len(strict_hits), len(soft_hits), sum(soft_hits.values()))):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)],
            [*batch.schema.names, "strict_hits", "soft_hits", "soft_weight"],
        )


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    strict=STRICT_TERMS,
    soft=None,
    soft_limit=SOFT_LIMIT,
    soft_distinct=SOFT_DISTINCT,
) -> DataFrame:
    """Judge urls. Returns ``id_col, host, path, rule, verdict, strict_hits, soft_hits, soft_weight`` per row.

    The longest fitting rule decides; without one a url is blocked on any strict term, or on at least ``soft_distinct``
    different soft terms whose weights reach ``soft_limit``. Terms count only between characters that are no ASCII letter or digit, in the whole
    url. One pass over the urls, no shuffle: any host may hold any share of the rows, and only id and url are read.

    Null urls, and urls without ``://``, have an empty host and path; a null url is allowed. Every row is judged by
    itself, so repeated rows and ids are no special case.
    """
    soft = SOFT_TERMS if soft is None else soft
    rows = pick(pages, _id=id_col, _url=url_col).withColumn("_url", F.col("_url").cast("string"))
    out = f"_id {rows.schema[0].dataType.simpleString()}, _url string, strict_hits long, soft_hits long, soft_weight long"
    counted = rows.mapInArrow(partial(_count_terms, url_at=1, strict=strict, soft=soft), out)
    url = F.coalesce(F.col("_url"), F.lit(""))
    judged = counted.withColumns({"host": url_host(url), "path": url_path(url)})
    judged = judged.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    soft_block = (F.col("soft_hits") >= soft_distinct) & (F.col("soft_weight") >= soft_limit)
    own = F.when((F.col("strict_hits") > 0) | soft_block, "block").otherwise("allow")
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        "strict_hits",
        "soft_hits",
        "soft_weight",
    )
