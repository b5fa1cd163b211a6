"""Small scalar expressions: parsing, time, lists, stable scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number pattern of raw price text.
PRICE_PATTERN = r"[\d,]+\.?\d*"

SCORE_DIGITS = 6


def parse_price(text: Column) -> Column:
    """First number in the text with thousands separators dropped; NULL when there is none."""
    number = F.replace(F.regexp_extract(text, PRICE_PATTERN, 0), F.lit(","), F.lit(""))
    return number.try_cast("double")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def millis_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def tail(values: Column, n: int) -> Column:
    """The last ``n`` elements, or all of them when there are fewer."""
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, F.lit(n))


def pad_right(values: Column, n: int, pad) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(values), F.lit(0))))


def pad_tail(values: Column, n: int, pad) -> Column:
    return pad_right(tail(values, n), n, pad)


def spaced(values: Column) -> Column:
    """A list as one space-separated string."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


def flat_text(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " "), F.lit(""))


def stable_score(score: Column) -> Column:
    """Rounded score: equal candidates tie exactly, whatever order their terms were summed in."""
    return F.round(score, SCORE_DIGITS)


def significant_score(score: Column) -> Column:
    """Score to the 24 bits of a float: equal candidates tie at any magnitude, and small scores keep their order."""
    return score.cast("float").cast("double")


def sample_key(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random sort key that any engine with md5 can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
