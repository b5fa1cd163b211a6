"""Personal data: validated patterns, plus candidates that boosted trees take for personal data.

Column expressions and MLlib only: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import pick, stage

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. They are written so that Java's engine finds the same leftmost matches in linear
# time and without recursion: a match starts where its run of characters starts or where the last match ended, and
# repetitions that never need to give back are possessive. Of the card pattern's runs only those of 12 to 19 digits match.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Generators: anything in the form of each kind, whether or not it would validate. Matches of different kinds may overlap.
CANDIDATE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?(?:\((?:at|AT)\)|\[(?:at|AT)\]) ?)[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:[.,][0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?:\+|(?<![0-9+])00)[0-9](?:[ ().-]{0,3}[0-9]){7,14}+(?![0-9])"
    r"|(?<![0-9+])\(?[0-9]{2,4}+\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}
# Own list: words that stand near personal data of a kind.
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "tel|phone|call|fax|mobile|cell",
}
_MAIL_SIGNS = ("@", "(at)", "(AT)", "[at]", "[AT]")
FIT_CANDIDATES = 20_000  # different candidates of each kind that the trees are fitted on, at most
HELD_OUT = 3  # one in so many different candidates is never fitted and sets the thresholds
PRECISION = 0.95
_TREES, _DEPTH = 12, 4
_BEFORE, _AFTER = 24, 12


def _with_matches(docs: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds for every kind an array ``prefix + kind`` of (start, end, s, before, after) of all leftmost matches.

    Starts are sums of the lengths of gaps and matches, in code points.
    """
    t = F.col(text)
    mail = reduce(lambda a, b: a | b, [t.contains(x) for x in _MAIL_SIGNS])
    out = docs.withColumn("_digits", t.rlike("[0-9]"))
    matches = {}
    for kind, pattern in patterns.items():  # a text without a kind's necessary characters is not searched
        possible = mail if kind == "email" else F.col("_digits")
        matches[f"_m_{kind}"] = F.when(possible, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.expr("cast(array() as array<string>)"))
    out = out.withColumns(matches)
    gaps = {f"_g_{kind}": F.when(F.size(f"_m_{kind}") > 0, F.split(t, pattern, -1)) for kind, pattern in patterns.items()}
    out = out.withColumns(gaps)
    spans = {}
    for kind in patterns:
        m, g = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        none = F.expr("cast(array() as array<struct<start:int,end:int,s:string,before:string,after:string>>)")
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        every = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, _grower(m, g), lambda acc: acc.spans)
        spans[f"{prefix}{kind}"] = F.when(F.size(m) > 0, every).otherwise(none)
    return out.withColumns(spans).drop("_digits", *matches, *gaps)


def _grower(m: Column, g: Column):
    """Adds the i-th match to (at, spans): ``at`` is where the last match ended."""

    def grow(acc: Column, i: Column) -> Column:
        start = acc.at + F.length(F.get(g, i))
        end = start + F.length(F.get(m, i))
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            F.get(m, i).alias("s"),
            F.right(F.get(g, i), F.lit(_BEFORE)).alias("before"),
            F.left(F.get(g, i + 1), F.lit(_AFTER)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(span)).alias("spans"))

    return grow


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, 1)) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda c: _valid(kind, c.s)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(
        spans, lambda c: F.struct(c.start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), c.end.alias("end"), F.lit(kind).alias("kind"))
    )


def _count(s: Column, pattern: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)


def _features(kind: str, c: Column) -> Column:
    """Format of the span and what stands next to it. No feature repeats a validator of the base patterns."""
    digits = _digits(c.s)
    runs = F.transform(F.split(c.s, "[^0-9]+"), lambda p: F.length(p))
    values = [
        F.lit(KINDS.index(kind)),
        F.length(c.s),
        F.length(digits),
        _count(c.s, r"\p{L}"),
        _count(c.s, r"[ ()]"),
        _count(c.s, r"[.,]"),
        _count(c.s, r"[-_/]"),
        F.array_max(runs),
        F.size(runs),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.ascii(F.left(digits, F.lit(1))),
        F.when(c.s.startswith("+"), 1).otherwise(0),
        F.when(c.s.contains("@"), 1).otherwise(0),
        _char_class(F.right(c.before, F.lit(1))),
        _char_class(F.left(c.after, F.lit(1))),
        F.when(F.lower(c.before).rlike(CONTEXT[kind]), 1).otherwise(0),
        F.when(c.before.rlike(r"[=:#\"']\s*$"), 1).otherwise(0),
        _count(c.before, "[0-9]"),
        _count(c.after, "[0-9]"),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def _overlaps(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b.start < span.end) & (span.start < b.end))


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_base`` (validated spans in order) and ``_candidates`` (start, k, end, kind, x) to the documents."""
    rows = docs.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = _with_matches(rows, "_t", BASE_PATTERNS, "_b_")
    valid = [_named(k, F.filter(F.col(f"_b_{k}"), _validator(k))) for k in KINDS]
    rows = rows.withColumn("_base", F.array_sort(F.concat(*valid))).drop(*[f"_b_{k}" for k in KINDS])
    rows = _with_matches(rows, "_t", CANDIDATE_PATTERNS, "_c_")

    def candidate(kind: str):
        return lambda c: F.struct(
            c.start.alias("start"),
            F.lit(KINDS.index(kind)).alias("k"),
            c.end.alias("end"),
            F.lit(kind).alias("kind"),
            _features(kind, c).alias("x"),
        )

    found = F.concat(*[F.transform(F.col(f"_c_{k}"), candidate(k)) for k in KINDS])
    return rows.withColumn("_candidates", found).drop("_t", *[f"_c_{k}" for k in KINDS])


def examples(spans: DataFrame) -> DataFrame:
    """``(k, x, label, n, held_out)``: the different candidates of every kind and how often each stands in the texts.

    A candidate that equals a validated span of its kind is an example of personal data, any other is not. All candidates
    of the same features are held out or none.
    """
    rows = spans.select("_base", F.explode("_candidates").alias("c"))
    label = F.exists("_base", lambda b: (b.k == F.col("c.k")) & (b.start == F.col("c.start")) & (b.end == F.col("c.end")))
    rows = rows.select(F.col("c.k").alias("k"), F.col("c.x").alias("x"), label.cast("double").alias("label"))
    counts = rows.groupBy("k", "x", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("held_out", F.pmod(F.xxhash64(F.lit("calibration"), "x"), F.lit(HELD_OUT)) == 0)


def fit_trees(spans: DataFrame) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Boosted trees over candidates and a margin threshold for each kind.

    At most ``FIT_CANDIDATES`` of each kind, in the order of a hash of their features, are fitted; equal ones count once. A
    kind's threshold is the lowest margin from which on at least ``PRECISION`` of all its held-out candidates validate, so
    a candidate above it looks like those that do. A kind without such a margin adds nothing. None if the candidates to
    fit are of one class, however many there are.
    """
    rows = stage(examples(spans))
    order = [F.xxhash64("x"), "label"]
    to_fit = rows.where(~F.col("held_out"))
    sample = stage(reduce(DataFrame.unionByName, [to_fit.where(F.col("k") == k).orderBy(*order).limit(FIT_CANDIDATES) for k in range(len(KINDS))]))
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=_TREES, maxDepth=_DEPTH, stepSize=0.3, seed=7, maxMemoryInMB=64, checkpointInterval=-1)
    model = trees.fit(sample.select(array_to_vector("x").alias("features"), "label"))
    scored = rows.where("held_out").select("k", "label", "n", F.round(margin(model, F.col("x")), 3).alias("m"))
    good = F.sum(F.col("label") * F.col("n")).alias("good")
    steps = scored.groupBy("k", "m").agg(good, F.sum("n").alias("n")).orderBy("k", F.desc("m")).collect()
    thresholds: dict[int, float] = {}
    for k in range(len(KINDS)):
        good = n = 0
        for row in (r for r in steps if r["k"] == k):
            good, n = good + row["good"], n + row["n"]
            if good / n >= PRECISION:
                thresholds[k] = row["m"]
    return model, thresholds


def _tree(node, x: Column) -> Column:
    """A fitted regression tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    low = F.get(x, F.lit(int(split.featureIndex()))) <= F.lit(float(split.threshold()))
    return F.when(low, _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def margin(model: GBTClassificationModel, x: Column) -> Column:
    """The weighted sum of the trees as a column expression over an array of features."""
    parts = [F.lit(float(w)) * _tree(t._java_obj.rootNode(), x) for w, t in zip(model.treeWeights, model.trees)]
    return reduce(lambda a, b: a + b, parts)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c.kind, c.start.cast("string"), c.end.cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (of the base spans), ``base`` and ``spans`` (kind:start:end by
    start and then kind, comma-joined; code points, end exclusive) and ``n_added`` for every row.

    Base spans are the leftmost matches of each pattern that validate. Added spans are candidates above their kind's
    threshold that overlap no base span. Everything is a column expression over one row, so there is no shuffle but of
    the counts of equal candidates for the fit; the text is read once for the fit and once for the result.

    Null and empty texts have no spans. Repeated rows and ids are rows of their own; a null id stays null. With
    candidates of one class only there is nothing to fit and nothing is added.
    """
    rows = with_spans(pick(docs, _id=id_col, _text=text_col), "_text").drop("_text")
    fitted = fit_trees(rows)
    added = F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)")
    if fitted:
        model, thresholds = fitted

        def chosen(c: Column) -> Column:
            over = F.lit(False)
            score = margin(model, c.x)
            for k, low in thresholds.items():
                over = over | ((c.k == k) & (F.round(score, 3) >= low))
            return ~_overlaps(c, F.col("_base")) & over

        picked = F.filter("_candidates", chosen)
        added = F.transform(picked, lambda c: F.struct(c.start.alias("start"), c.k.alias("k"), c.end.alias("end"), c.kind.alias("kind")))
    rows = rows.withColumn("_added", F.array_distinct(added))
    base_kinds = F.transform("_base", lambda c: c.kind)
    counts = [(F.size(base_kinds) - F.size(F.array_remove(base_kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col("_id").alias(id_col),
        *counts,
        _text(F.col("_base")).alias("base"),
        _text(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )
