"""Quality rules, spelling variants and collocations: brute force, held-out accuracy, odd rows, empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.llm import collocations, quality_rules, spelling

LETTERS = "abcdeéñß"
DOCS = "doc_id long, text string, lang string, _stats string, word string, n int"


def documents(spark, rows):
    """(doc_id, text, lang) rows with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, s, "x", "other", 7) for i, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, None, None), (2, "", "a"), (None, "no id here", "a"), (None, None, None), (3, "twice twice", "b"),
            (3, "twice twice", "b"), (4, " \n\t ", "b"), (5, long, "a"), (6, "x" * 100_000, "c"), (7, "é\U0001f600\n" * 50, "c")]


# --- spelling


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if within_one(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return rows


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices(LETTERS, k=rng.randint(3, 7))) for _ in range(700)} | {"aaaa", "aaaaa", "aaaaaa"}
    counts = {w: rng.choice([5, 6, 30, 31, 160, 900, 5000]) for w in sorted(words)}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long").repartition(5)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}
    expected = brute_variants(counts)
    assert found == expected
    assert sum(r[0] is not None and r[0] != r[1] for r in expected.values()) > 5  # chains of forms


def test_reduced_neighbourhood_is_full():
    """Each reduced word within one edit once: equal to edits made by hand on the symbols."""
    word = "abcé"
    symbols = tuple(spelling._SYMBOL_OF[[ord(c) & 0xFF for c in word]].tolist())

    def key(s):
        total = 0
        for j, c in enumerate(s):
            total = (total + (c + 1) * pow(int(spelling._FACTOR), j, 1 << 64)) % (1 << 64)
        return total

    edits = {symbols} | {symbols[:i] + symbols[i + 1 :] for i in range(4)}
    edits |= {symbols[:i] + (c,) + symbols[i + 1 :] for i in range(4) for c in range(spelling.SYMBOLS)}
    edits |= {symbols[:i] + (c,) + symbols[i:] for i in range(5) for c in range(spelling.SYMBOLS)}
    found = [k for _, keys in spelling.neighbour_keys([word]) for k in keys.tolist()]
    assert len(found) == len(set(found)) and set(found) == {key(s) for s in edits}
    assert spelling.reduced_keys([word]).tolist() == [key(symbols)]


def test_words_of_texts(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices(LETTERS, k=9)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(base, k=200)) + ". ÀB÷CDE x1y2Ωabcdef", "a") for i in range(30)] + odd_rows()
    expected = Counter()
    for doc, text, _ in rows:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode())).items():
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run
            expected[run] += n * (len(run) >= 6)
    expected = {w: n for w, n in expected.items() if n >= 5}
    found = spelling.vocabulary(documents(spark, rows).repartition(4), noise=7)
    assert {r["word"]: r["n"] for r in found.collect()} == expected
    assert spelling.spelling_variants(found.where("false")).collect() == []
    assert spelling.vocabulary(documents(spark, odd_rows()).where("false")).collect() == []


# --- collocations


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in (1, 2, 3, 4):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        phrases = [p for p, a in f.items() if a >= least and len(p) > 1]
        for p in phrases:
            a = f[p]
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f[q] >= 80 * a for q in phrases
            )
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("trie_phrases", [collocations.TRIE_PHRASES, 60])
def test_phrases_equal_brute_force(spark, trie_phrases):
    rng = random.Random(9)
    words = ["the", "of", "é", "|", "x y", "Zed", "a", "b"]
    rows = [
        (i, " ".join(rng.choices(words, k=60)) + rng.choice([".", "\t", "!\r\n", " the of the of "]) + "New York City hall " * 3, lang)
        for i, lang in enumerate(["a", "b", None] * 12)
    ] + odd_rows()
    found = collocations.collocations(documents(spark, rows).repartition(3), min_count=12, top=40, trie_phrases=trie_phrases)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 12, 40)


def test_no_phrases(spark):
    assert collocations.collocations(documents(spark, odd_rows()).where("false")).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, "a"), (2, "", None)])).collect() == []


def test_trie_finds_exactly_its_phrases():
    rng = np.random.default_rng(4)
    for length, top, size in itertools.product((2, 3), (3, 12, 3000), (1, 50, 700)):
        phrases = np.unique(rng.integers(1, top + 1, (size, length)), axis=0)
        trie = collocations.Trie(phrases)
        rows = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
        text = np.concatenate([rng.integers(0, top + 2, 500), phrases.ravel()]).astype(np.int32)
        expected = [rows.get(tuple(text[i : i + length].tolist()), -1) for i in range(len(text))]
        assert trie.rows_at(text).tolist() == expected
    assert collocations.Trie(np.zeros((0, 2), np.int32)).rows_at(np.arange(9, dtype=np.int32)).tolist() == [-1] * 9


# --- quality


def good(rng):
    return ". ".join(" ".join(rng.choice(PROSE) for _ in range(9)).capitalize() for _ in range(rng.randint(2, 9))) + "."


PROSE = ["".join(p) for p in itertools.product("bdlmnrst", "aeiou", "lnrst")]


def bad(rng):
    word = rng.choice(PROSE)
    return rng.choice([f"{word} " * 60, " ".join(f"{rng.choice(PROSE)}%%%" for _ in range(50)), good(rng).upper() + "!!" * 20])


def test_quality_is_learned_from_rows_that_are_not_held_out(spark):
    rng = random.Random(2)
    quality = {i: int(rng.random() < 0.7) for i in range(600)}
    rows = [(i, good(rng) if q else bad(rng), "a") for i, q in quality.items()] + [(900, None, "a"), (901, "", "a"), (None, "x", "a")]
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in quality}
    # Labels of held-out rows are turned round: learning from any of them would show. Some labels have no document.
    labels = [(i, 1 - q if out[i] else q, 0) for i, q in quality.items()] + [(5000 + i, i % 2, 0) for i in range(50)]
    labels += [(None, 1, 0), (2, None, 0), (3, 5, 0), (900, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, _order int")
    docs = documents(spark, rows)
    model = quality_rules.train(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = quality_rules.score(docs, model).withColumn("held", quality_rules.held_out())
    found = {r["doc_id"]: r for r in scored.collect()}
    assert all(found[i]["held"] == out[i] for i in quality)
    right = sum((found[i]["_score"] >= 0.5) == (quality[i] == 1) for i in quality if out[i])
    assert right >= 0.97 * sum(out.values())
    assert found[900]["_score"] == found[901]["_score"] and 0 <= found[900]["_score"] <= 1
    assert found[900]["_stats"] == "x" and found[900]["word"] == "other"  # columns of the input stay


def test_rules_as_columns_equal_rules_as_arrays(spark):
    rng = np.random.default_rng(8)
    rows = rng.random((900, len(quality_rules.STATISTICS)))
    labels = ((rows[:, 3] > 0.4) & (rows[:, 7] < 0.7)).astype(int)
    model = quality_rules.fit(rows, labels, (0.5, 0.5))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "s array<double>").select(model.column(F.col("s")).alias("p"))
    by_columns = np.array([r["p"] for r in df.collect()])
    margin = model.bias + sum(w * r.covers(rows) for r, w in zip(model.rules, model.weights))
    assert np.allclose(by_columns, 1 / (1 + np.exp(-margin)))
    assert ((by_columns >= 0.5) == (labels == 1)).mean() > 0.97
    assert any("symbols" in str(r) or "upper" in str(r) for r in model.rules)


def test_quality_of_odd_rows(spark):
    none = quality_rules.fit(np.zeros((0, len(quality_rules.STATISTICS))), np.zeros(0, int))
    one = quality_rules.fit(np.ones((5, len(quality_rules.STATISTICS))), np.ones(5, int), (0.0, 1.0))
    assert none.rules == [] and one.rules == [] and one.bias > 5
    docs = documents(spark, odd_rows())
    rows = quality_rules.score(docs, none).collect()
    assert len(rows) == len(odd_rows()) and {r["_score"] for r in rows} == {0.5}
    assert quality_rules.score(docs.where("false"), none).collect() == []
    long = "Some words here.\n" * 200_000  # longer than one part
    assert np.isfinite(quality_rules.measure(long)).all()
    assert quality_rules.measure("") == [0.0] * len(quality_rules.STATISTICS)
    some = quality_rules.measure("a b c " * 10)
    assert np.allclose(some, quality_rules.measure("a b c " * 10))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.train(docs, empty).rules == []
