"""Word sequences and word n-gram sets of texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_CODES, _PLACES = 0x2100, 64
_DRAW = np.random.default_rng(23)


def odd_factors(n: int) -> np.ndarray:
    return _DRAW.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_INSIDE = np.array([chr(i).isalnum() for i in range(_CODES)])
_CODE_HASH, _PLACE_HASH, _GRAM_HASH = odd_factors(_CODES), odd_factors(_PLACES), odd_factors(64)
_LOWER = np.array([ord(chr(i).lower()) for i in range(256)])
_BYTE_INSIDE = _INSIDE[_LOWER].tobytes()
# What a character of one byte adds to its word at each place; others add nothing, nor does a place beyond the table.
_BYTE_HASH = np.append((_PLACE_HASH[:, None] * np.where(_INSIDE[_LOWER], _CODE_HASH[_LOWER], 0).astype(np.uint64)).ravel(), np.uint64(0))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes so that every part of the result may be used by itself."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, text after text, the number of words of each text, and starts and ends.

    Words are runs of letters and digits of the lower-cased text; characters beyond the table count as letters. Starts and
    ends are code points of the text (of its lower-cased form, where that has another length).
    """
    found = _byte_words(texts)
    if found is None:
        lowered = [t.lower() for t in texts]
        size, found = [len(t) + 1 for t in lowered], _any_words(lowered)
    else:
        size = [len(t) + 1 for t in texts]
    sums, starts, ends = found
    size = np.array(size, dtype=np.int64)
    lengths = np.cumsum(size)
    counts = np.diff(np.searchsorted(starts, lengths), prepend=0)
    base = np.repeat(lengths - size, counts)
    return mixed(sums), counts, starts - base, ends - base


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # every text ends outside of words
    edges = np.concatenate([[0], edges]) if len(inside) and inside[0] else edges
    return edges[::2], edges[1::2]


def _byte_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Sums, starts and ends of the words, as ``_any_words`` gives them, for texts whose characters all fit in a byte, whose
    lower case has the same length, and without long words. None for others."""
    try:
        raw = "\n".join([*texts, ""]).encode("latin-1")
    except UnicodeEncodeError:
        return None
    starts, ends = _edges(np.frombuffer(raw.translate(_BYTE_INSIDE), dtype=bool))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    if (ends - starts).max() > _PLACES:
        return None
    first = int(starts[0])
    at = np.arange(first << 8, len(raw) << 8, 256)
    at -= np.repeat(starts << 8, np.diff(starts, append=len(raw)))
    at += np.frombuffer(raw, dtype=np.uint8)[first:]
    return np.add.reduceat(_BYTE_HASH.take(at, mode="clip"), starts - first), starts, ends


def _any_words(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = codes >= _CODES
    if high.any():
        inside = _INSIDE[np.where(high, 0, codes)] | high
        values = np.where(high, mixed(codes.astype(np.uint64)) | np.uint64(1), _CODE_HASH[np.where(high, 0, codes)])
    else:
        inside, values = _INSIDE[codes], _CODE_HASH[codes]
    starts, ends = _edges(inside)
    opened = np.zeros(len(codes), dtype=np.int32)
    opened[starts] = starts
    place = np.arange(len(codes), dtype=np.int32) - np.maximum.accumulate(opened)
    factors = _PLACE_HASH[place & (_PLACES - 1)]
    if len(starts) and (ends - starts).max() > _PLACES:
        factors = np.where(inside, factors + (place >> 6).astype(np.uint64) * np.uint64(0x94D049BB133111EA), factors)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * factors, dtype=np.uint64)])
    return sums[ends] - sums[starts], starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, text after text, and the number of words of each."""
    return word_places(texts)[:2]


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams.

    A text of fewer than ``n`` words, but at least one, has one n-gram of all its words.
    """
    words, counts = word_hashes(texts)
    width = max(len(words) - n + 1, 0)
    grams = np.zeros(width, dtype=np.uint64)
    for j in range(n):
        grams += words[j : j + width] * _GRAM_HASH[j]
    grams = mixed(grams)
    found, at = [], 0
    for count in counts.tolist():
        if count >= n:
            found.append(np.unique(grams[at : at + count - n + 1]))
        elif count:
            short = (words[at : at + count] * _GRAM_HASH[:count]).sum(dtype=np.uint64, keepdims=True)
            found.append(mixed(short + np.uint64(count)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
        at += count
    return found
