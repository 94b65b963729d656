"""Personal data by candidate gradient boosting, in DataFrame functions only.

Method: high-recall generators (regular expressions over whole texts) propose overlapping
candidate spans; every candidate gets format features (length, digit groups, separators,
checksum, character classes) and context features (the characters around it, the density of
digits near it); gradient-boosted trees trained on all candidates of the table score them, and
a threshold per generator selects the redactions.  Thresholds are calibrated for precision over
all candidates as well, each scored by trees that were trained without its fold.  No labels of
personal data are given, so the trees learn from weak labels (a candidate is positive when a
strict format rule of its generator holds); the rules themselves are not features.

Base spans (fixed rules per kind) always stay; the boosted ones are added to them.

Scale: a text is scanned by a pattern only if it meets the pattern's cheap guard; a document's candidates stay in an array of
its row and the trees are applied there as one SQL expression, so applying the model needs no
shuffle and no join.  Training shuffles the candidates (not the texts) once and keeps their
different feature vectors with how often each occurs; trees and thresholds use these counts as
weights, which loses no candidate.  Patterns use possessive quantifiers and anchor at run starts, so a long run
of digits or letters costs linear time and no recursion.

Defined cases: a null text has no spans (its redaction stays null); repeated rows are handled
row by row, but candidates alike in match, place and context are learnt from once; overlapping
spans are redacted as one, named by the first.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze
from .tables import table

#: Base patterns, in Java's syntax: same matches as the plain forms of the contract, written
#: with possessive quantifiers; ``\G`` admits a start right after the previous match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(BASE)

#: Generators of further candidates: (kind, pattern, strict weak-label rule).
GENERATORS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+", r"^[^@ ]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    "ip": (r"(?:(?<![0-9.])|\G)[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+", r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$"),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}+(?:[ -][0-9]{4}+){2,3}+(?:[ -][0-9]{1,3}+)?+)(?![0-9])", r"^[3-6]"),
    "phone": (r"(?:\+[0-9]{1,3}+[ .-]?+)?+(?:\([0-9]{2,4}+\) ?+|(?<![0-9])[0-9]{3}+[ .-])[0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9])", r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
    "secret": (r"[A-Za-z0-9_+/=:-]{16,}+", r"^((password|passwd|pwd|secret|token|api[_-]?key)[=:].{6,}|AKIA[0-9A-Z]{16}|(gh[pousr]|sk|pk)_[A-Za-z0-9_]{16,})$"),
}
ALL_KINDS = list(GENERATORS)

#: A condition that every match's text meets, cheaper to test than the pattern itself:
#: (substrings of which one is there, or a pattern of a few characters).
GUARDS = {
    ("base", "email"): ["@"],
    ("base", "ip"): r"[0-9]\.[0-9]",
    ("base", "card"): r"[0-9][ -]?[0-9]",
    ("base", "phone"): ["+"],
    ("candidates", "email"): ["@", "(at)", "[at]"],
    ("candidates", "ip"): r"[0-9]\.[0-9]",
    ("candidates", "card"): r"[0-9]{4}",
    ("candidates", "phone"): r"[0-9]{3}[ .-][0-9]{3}",
}
TREES, DEPTH, LEAF, FOLDS, PRECISION, FEW, CONTEXT = 12, 3, 5, 5, 0.9, 20, 24
#: The candidates of a (kind, weak label) train with equal weights that sum to this at most, so
#: that a frequent one does not drown the others; thresholds count every candidate as one.
BALANCE = 400
#: Feature vectors a task when trees are trained.
PART = 20_000
SPAN = "struct<start: int, kind_no: int, kind: string, stop: int, match: string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def placed(kind: str, found: Column, pieces: Column) -> Column:
    """Matches of one pattern as (start, kind_no, kind, stop, match); offsets are code points,
    from the lengths of the matches and of the pieces of text between them."""
    empty = F.expr(NO_SPANS)

    def step(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.char_length(both["piece"])
        stop = start + F.char_length(both["match"])
        names = (start.alias("start"), F.lit(ALL_KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"))
        span = F.struct(*names, stop.alias("stop"), both["match"].alias("match"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(empty)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    value = F.transform(each, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_valid(span: Column, kind: str) -> Column:
    """Whether a base match of the kind counts."""
    m = span["match"]
    n = F.char_length(digits_of(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits_of(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def valid(kind: str):
    return lambda span: base_valid(span, kind)


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def may_match(text: Column, part: str, kind: str) -> Column:
    guard = GUARDS.get((part, kind))
    if isinstance(guard, str):
        return F.col("digits") & text.rlike(guard)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in guard]) if guard else F.col("digits")


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, base, candidates): the whole input row as a struct, so that no name can clash."""
    patterns = [("base", k, p) for k, p in BASE.items()] + [("candidates", k, p) for k, (p, _) in GENERATORS.items()]
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("digits", text.rlike("[0-9]"))
    found = rows.withColumns({f"{t}_{k}": F.when(may_match(text, t, k), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for t, k, p in patterns})
    spans = {}
    for t, k, p in patterns:
        spans[t, k] = placed(k, F.col(f"{t}_{k}"), F.split(text, p, -1))
    # a secret without a digit is a word
    spans["candidates", "secret"] = F.filter(spans["candidates", "secret"], lambda s: s["match"].rlike("[0-9]"))
    base = [F.filter(spans["base", k], valid(k)) for k in KINDS]
    candidates = [spans["candidates", k] for k in GENERATORS]
    return found.select("row", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*candidates)).alias("candidates"))


def with_context(candidates: Column, text: Column) -> Column:
    """Candidates as structs of the span and the characters around it."""

    def around(s: Column) -> Column:
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, start + 1, s["start"] - start)
        return F.struct(s.alias("span"), before.alias("before"), F.substring(text, s["stop"] + 1, F.lit(CONTEXT)).alias("after"))

    return F.transform(candidates, around)


def features(candidate: Column) -> dict[str, Column]:
    """Format and context features of a candidate struct (span, before, after), as doubles."""
    m, before, after = candidate["span"]["match"], candidate["before"], candidate["after"]
    n, digits = F.char_length(m), digits_of(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")

    def count(s: Column, keep: str) -> Column:
        return F.char_length(F.regexp_replace(s, f"[^{keep}]", ""))

    values = {
        "kind_no": candidate["span"]["kind_no"],
        "length": n,
        "digits": F.char_length(digits),
        "digit_share": F.char_length(digits) / n,
        "upper": count(m, "A-Z"),
        "lower": count(m, "a-z"),
        "separators": count(m, " ()-"),
        "dots": count(m, "."),
        "at_signs": count(m, "@"),
        "groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)),
        "first_plus": m.startswith("+"),
        "first_paren": m.startswith("("),
        "first_digit": F.coalesce(F.regexp_extract(m, "^[^0-9]*([0-9])", 1).try_cast("int"), F.lit(-1)),
        "checksum": F.when((F.char_length(digits) >= 12) & (F.char_length(digits) <= 19), luhn(digits)).otherwise(F.lit(False)),
        "equals": count(m, "="),
        "word_before": before.rlike("[A-Za-z0-9]$"),
        "word_after": after.rlike("^[A-Za-z0-9]"),
        "letters_before": count(before, "A-Za-z") > 0,
        "letters_after": count(after, "A-Za-z") > 0,
        "marks_before": count(before, "|;,:"),
    }
    return {k: v.cast("double") for k, v in values.items()}


def weak_label(span: Column) -> Column:
    rules = [F.when(span["kind"] == k, span["match"].rlike(rule)) for k, (_, rule) in GENERATORS.items()]
    checked = F.when(span["kind"] == "card", luhn(digits_of(span["match"]))).otherwise(F.lit(True))
    return F.coalesce(*rules, F.lit(False)) & checked


class SpanModel:
    """Boosted trees over candidate features, as SQL, with a calibrated threshold per kind."""

    def __init__(self, margin, thresholds: dict[str, float]) -> None:
        self.margin, self.thresholds = margin, thresholds

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text") -> SpanModel | None:
        """Fit and calibrate on all different candidates of the table.  None when there is
        nothing to learn."""
        text = F.coalesce(F.col("row")[text_col], F.lit(""))
        rows = with_spans(docs.select(text_col), text_col).where(F.size("candidates") > 0)
        rows = rows.select(F.explode(with_context(F.col("candidates"), text)).alias("c")).distinct()
        values = features(F.col("c"))
        names = list(values)
        fold = F.pmod(F.xxhash64("c"), F.lit(FOLDS)).alias("fold")
        rows = rows.select(F.col("c.span.kind").alias("kind"), weak_label(F.col("c.span")).cast("double").alias("label"), fold, *[v.alias(k) for k, v in values.items()])
        counted = freeze(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
        groups = counted.groupBy("kind", "label", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("vectors")).collect()
        if len({g["label"] for g in groups}) < 2:
            return None
        sizes = Counter()
        for g in groups:
            sizes[g["kind"], g["label"]] += g["n"]
        each = {of: min(1.0, BALANCE / n) for of, n in sizes.items()}
        weight = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("label") == y), F.lit(w)) for (k, y), w in each.items()])
        data = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(counted.withColumn("weight", F.col("n") * weight))
        vectors = sum(g["vectors"] for g in groups)
        # trees take many short passes: as many tasks as the vectors need, not as the shuffle had
        data = freeze(data.coalesce(vectors // PART + 1))
        # Spark ML looks for split points in maxBins ** 2 rows: in all of them
        splits = max(32, isqrt(vectors) + 1)

        def fit(without: int | None = None):
            used = [g for g in groups if g["fold"] != without]
            if not used:  # all candidates are of one fold: nothing is known of them
                return lambda get: F.lit(0.0)
            total = sum(g["n"] * each[g["kind"], g["label"]] for g in used)
            # a leaf needs the weight of LEAF candidates
            shape = {"maxIter": TREES, "maxDepth": DEPTH if total >= 2 * LEAF else 0, "maxBins": splits, "minWeightFractionPerNode": min(LEAF / total, 0.49)}
            trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=7, **shape)
            return as_sql(trees.fit(data if without is None else data.where(F.col("fold") != without)), names)

        bins = []
        for held in sorted({g["fold"] for g in groups}):
            score = probability(fit(held)(lambda name: F.col(name)))
            counts = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits")]
            bins += data.where(F.col("fold") == held).groupBy("kind", F.floor(score * 20).alias("bin")).agg(*counts).collect()
        return cls(fit(), calibrate(bins))

    def chosen(self, candidates: Column) -> Column:
        """The spans of the candidates (with context) whose score reaches their kind's threshold."""
        measured = lambda c: F.struct(*[v.alias(k) for k, v in features(c).items()])
        scored = F.transform(candidates, lambda c: F.struct(c["span"].alias("span"), measured(c).alias("f")))

        def passes(x: Column) -> Column:
            limit = F.coalesce(*[F.when(x["span"]["kind"] == k, F.lit(t)) for k, t in self.thresholds.items()], F.lit(2.0))
            return probability(self.margin(lambda name: x["f"][name])) >= limit

        return F.transform(F.filter(scored, passes), lambda x: x["span"])


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


def calibrate(bins: list) -> dict[str, float]:
    """Per kind the lowest score (in steps of 1/20) above which PRECISION of all its
    candidates are positive; kinds with fewer than FEW of them take the one of all kinds
    together, and a kind that reaches the precision nowhere selects nothing."""

    def lowest(rows: list) -> float | None:
        n_of, hits_of = Counter(), Counter()
        for r in rows:  # a bin comes once per fold and kind
            n_of[r["bin"]] += r["n"]
            hits_of[r["bin"]] += r["hits"]
        best, n, hits = None, 0, 0
        for step in sorted(n_of, reverse=True):
            n, hits = n + n_of[step], hits + hits_of[step]
            if hits >= PRECISION * n:
                best = step / 20
        return best

    own = {k: [r for r in bins if r["kind"] == k] for k in ALL_KINDS}
    found = {k: lowest(rows if sum(r["n"] for r in rows) >= FEW else bins) for k, rows in own.items()}
    return {k: t for k, t in found.items() if t is not None}


def as_sql(model: GBTClassificationModel, names: list[str]):
    """The boosted trees' weighted sum as a function of a feature lookup (name -> Column)."""

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        split = node.split()
        return names[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    trees = [(w, read(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def column(tree, get) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        name, threshold, left, right = tree
        return F.when(get(name) <= threshold, column(left, get)).otherwise(column(right, get))

    return lambda get: reduce(lambda a, b: a + b, [F.lit(float(w)) * column(t, get) for w, t in trees])


def personal_data(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """(row, base, spans): base spans and all spans (base and chosen), by start and kind."""
    found = with_spans(docs, text_col)
    if model is None:
        return found.select("row", "base", F.col("base").alias("spans"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    near = found.select("row", "base", with_context(F.col("candidates"), text).alias("near"))
    return near.select("row", "base", F.array_sort(F.array_union("base", model.chosen(F.col("near")))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets."""
    found = personal_data(docs, text_col, SpanModel.train(docs, text_col))
    text, last = F.col("row")[text_col], F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], between, mark).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", last, step, rest)).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, model=SpanModel.train(docs))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, written), ",")
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
