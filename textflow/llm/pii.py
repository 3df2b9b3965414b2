"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall generators propose spans (with other kinds, or across each other). Spans that
pass the format rules of the four base kinds always stay. Other proposals are judged by boosted
trees over format and context features. The trees learn from proposals that carry evidence of
their own, outside the features: a validated number, a key's known beginning, letters and
digits that change places often, a spelt-out ``[at]``; against it a thousands separator, a date,
one digit only, a word with a number behind it, a sentence that ends in between. Proposals
without evidence are not learnt from, but judged like all others. On a fold that the trees have
not met, scores become probabilities by monotone regression, and a generator's threshold is the
least score whose calibrated probability is ``MIN_PRECISION``. Training needs only counts of the
distinct feature vectors of the whole corpus (``CELL_BOUND`` at most), so every document takes
part.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
EXTRA = ("number", "secret", "address")
KINDS = BASE + EXTRA
# \G: a match may begin where the last one ended. Where a run of characters can only match from
# its first character, the look-behind saves trying each of the others.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # proposals: seven or more digits with any marks between, long mixed tokens, spelt-out addresses
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[(\[] ?(?:@|at|AT) ?[)\]] ?| (?:at|AT) | ?@ ?)[A-Za-z0-9-]++(?: ?[(\[] ?(?:\.|dot|DOT) ?[)\]] ?| (?:dot|DOT) |\.)[A-Za-z]{2,}+",
}
#: evidence for (1) and against (0) a proposal, by its value; for and against by patterns
FOR = {
    "number": r"(?!)",
    "secret": r"^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk[-_])|(?:[0-9]+[A-Za-z]+){3}|(?:[A-Za-z]+[0-9]+){3}",
    "address": r"[(\[] ?(?:at|AT|@)|[(\[] ?(?:dot|DOT)",
}
AGAINST = {
    "number": r"^[0-9]{1,3}(?:\.[0-9]{3}){2,}+$|^(?:19|20)[0-9]{2}[-. ](?:0[1-9]|1[0-2])[-. ]",
    "secret": r"^[0-9_+/=-]+$|^[A-Za-z_+/=-]+[0-9]+[_+/=-]*$|^[0-9]+[A-Za-z_+/=-]+$",
    "address": r"^(?:the|a|an|and|or|is|was|be|look|arrive|stay) (?:at|AT) ",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "secret": "[0-9]", "address": "@|[(\\[ ](?:at|AT)[)\\] ]"}
TRIGGERS = r"(?i)(?:mail|phone|tel|call|fax|card|visa|account|ssn|key|token|secret|password|contact|ip|id)[^A-Za-z0-9]*$"
MIN_PRECISION = 0.9
TREES = 24
#: gen x digits x marks x before x trigger x length x label x fold
CELL_BOUND = 3 * 6 * 8 * 5 * 2 * 5 * 2 * 2
NO_EVIDENCE = -1
FEATURES = ("gen", "digits", "marks", "before", "trigger", "length")


def let(value: Column, body) -> Column:
    """``body`` over ``value`` worked out once (the optimizer may copy a column into a lambda, where it would run for each entry)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: int, op) -> Column:
    """Fold of all entries before each one, by chunks of 64: about 64 steps an entry, never all of them."""
    def fold(a: Column, start: Column) -> Column:
        return F.aggregate(a, start, op)

    nothing = F.lit(zero)

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 64).cast("int")), lambda c: fold(F.slice(v, c * 64 + 1, F.lit(64)), nothing))

        def with_chunks(cs: Column) -> Column:
            heads = F.transform(cs, lambda _, c: fold(F.slice(cs, F.lit(1), c), nothing))

            def each(i: Column, h: Column) -> Column:
                chunk = F.floor(i / 64).cast("int")
                return fold(F.slice(v, chunk * 64 + 1, i - chunk * 64), F.element_at(h, chunk + 1))

            return let(heads, lambda h: F.transform(v, lambda _, i: each(i, h)))

        return let(chunks, with_chunks)

    return let(values, over)


def _spans(kind: str) -> Column:
    """Array of (start, end, value) of the pattern's leftmost matches, in code points."""
    pattern, text = PATTERNS[kind], F.col("text")
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def with_values(v: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)), F.length)

        def with_gaps(g: Column) -> Column:
            begun = running(F.zip_with(g, v, lambda x, y: x + F.length(y)), 0, lambda x, y: x + y)
            starts = F.zip_with(begun, g, lambda x, y: x + y)
            return F.zip_with(starts, v, lambda x, y: F.struct(x.alias("start"), (x + F.length(y)).alias("end"), y.alias("value")))

        return F.when(F.size(v) > 0, let(gaps, with_gaps)).otherwise(empty)

    return F.when(text.rlike(GUARDS[kind]), let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), with_values)).otherwise(empty)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _features(gen: int, s: Column) -> Column:
    v = s["value"]
    n, size = F.length(_digits(v)), F.length(v)
    before = F.substring(F.col("text"), F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    last = F.right(before, F.lit(1))
    one_digit = F.replace(_digits(v), F.left(_digits(v), F.lit(1)), F.lit("")) == ""
    against = v.rlike(AGAINST[EXTRA[gen]]) | one_digit if EXTRA[gen] == "number" else v.rlike(AGAINST[EXTRA[gen]])
    bins = lambda x, *edges: sum(((x > e).cast("int") for e in edges), F.lit(0))
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.lit(gen).alias("gen"),
        bins(n, 3, 9, 11, 13, 16).alias("digits"),
        (v.rlike("[ ]").cast("int") + 2 * v.rlike("[.]").cast("int") + 4 * v.rlike("[-()+]").cast("int")).alias("marks"),
        F.when(last == "", 0).when(last == " ", 1).when(last.rlike("[A-Za-z]"), 2).when(last.rlike("[:=\"']"), 3).otherwise(4).alias("before"),
        before.rlike(TRIGGERS).cast("int").alias("trigger"),
        bins(size, 9, 15, 19, 31).alias("length"),
        F.when(against, 0).when(v.rlike(FOR[EXTRA[gen]]), 1).otherwise(NO_EVIDENCE).alias("evidence"),
    )


def _base_spans(i: int, kind: str) -> Column:
    valid = F.filter(_spans(kind), lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))


def _proposals(gen: int, kind: str) -> Column:
    return F.transform(_spans(kind), lambda s: _features(gen, s))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (array of start, kind, end) and ``cand``: spans of the generators with features, ``over`` (it overlaps a base span) and ``label`` (1 or 0 by evidence, -1 without)."""
    df = docs.withColumn("text", common.text_or_empty())
    df = df.withColumn("base", F.array_sort(F.concat(*(_base_spans(i, k) for i, k in enumerate(BASE)))))
    found = F.array_sort(F.concat(*(_proposals(g, k) for g, k in enumerate(EXTRA))))
    names = ("start", "end", *FEATURES)

    def labelled(base: Column) -> Column:
        def overlaps(c: Column) -> Column:
            return F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))

        def with_label(c: Column, over: Column) -> Column:
            # a base span is a validated number or address, and no secret
            label = F.when(over, F.when(c["gen"] == EXTRA.index("secret"), 0).otherwise(1)).otherwise(c["evidence"])
            return F.struct(*(c[n].alias(n) for n in names), over.alias("over"), label.alias("label"))

        return F.transform(found, lambda c: let(overlaps(c), lambda over: with_label(c, over)))

    return df.withColumn("cand", let(F.col("base"), labelled))


def _grow(cells: list, grad: list, hess: list, rows: list, depth: int, lam: float = 1.0):
    """A regression tree over cells by exact splits on the binned features."""
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    leaf = -g / (h + lam) * 0.3
    best = None
    for f in range(len(FEATURES)) if depth else []:
        by: dict = defaultdict(lambda: [0.0, 0.0])
        for i in rows:
            by[cells[i][0][f]][0] += grad[i]
            by[cells[i][0][f]][1] += hess[i]
        gl = hl = 0.0
        for cut in sorted(by)[:-1]:
            gl, hl = gl + by[cut][0], hl + by[cut][1]
            gain = gl * gl / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g * g / (h + lam)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut)
    if best is None or best[0] < 1e-6:
        return leaf
    _, f, cut = best
    left = [i for i in rows if cells[i][0][f] <= cut]
    right = [i for i in rows if cells[i][0][f] > cut]
    return (f, cut, _grow(cells, grad, hess, left, depth - 1), _grow(cells, grad, hess, right, depth - 1))


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[tuple[tuple, float, float]]) -> tuple[float, list]:
    """Logistic boosting over (features, rows, positive rows). Returns the base score and the trees."""
    total, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (total - pos + 1))
    score, trees = [start] * len(cells), []
    for _ in range(TREES if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [c[1] * q - c[2] for c, q in zip(cells, p)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p)]
        tree = _grow(cells, grad, hess, list(range(len(cells))), 3)
        trees.append(tree)
        score = [s + _value(tree, c[0]) for s, c in zip(score, cells)]
    return start, trees


def calibrated(scored: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(least score, probability) of ascending steps: monotone regression of (score, rows, positive rows) by pooling neighbours."""
    by_score: dict[float, list[float]] = {}
    for s, n, p in scored:
        cell = by_score.setdefault(s, [0.0, 0.0])
        cell[0], cell[1] = cell[0] + n, cell[1] + p
    steps: list[list[float]] = []
    for s in sorted(by_score):
        steps.append([s, *by_score[s]])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n, p = steps.pop()
            steps[-1][1], steps[-1][2] = steps[-1][1] + n, steps[-1][2] + p
    return [(s, p / n) for s, n, p in steps]


def fit(cand: DataFrame) -> dict:
    """Boosted trees and a threshold for each generator from the cells of all documents.

    A threshold is the least score whose calibrated probability, on the fold that the trees have
    not met, is ``MIN_PRECISION`` or more; a generator without such a score adds nothing.
    """
    cells = (
        cand.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)).alias("h"), F.explode("cand").alias("c"))
        .where(F.col("c.label") != NO_EVIDENCE)
        .groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES), (F.col("h") == 0).alias("test"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.label").cast("long")).alias("pos"))
    )
    rows = sorted(cells.collect(), key=lambda r: (r["test"], *(r[f] for f in FEATURES)))  # CELL_BOUND rows at most
    of = lambda test: [(tuple(r[f] for f in FEATURES), float(r["n"]), float(r["pos"])) for r in rows if r["test"] == test]
    start, trees = boost(of(False))
    limits = []
    for gen in range(len(EXTRA)):
        steps = calibrated([(start + sum(_value(t, x) for t in trees), n, p) for x, n, p in of(True) if x[0] == gen])
        limits.append(min((s for s, p in steps if p >= MIN_PRECISION), default=None))
    return {"start": start, "trees": trees, "limits": limits}


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(c[FEATURES[f]] <= cut, _tree_column(left, c)).otherwise(_tree_column(right, c))


def detect(cand: DataFrame, model: dict) -> DataFrame:
    """Adds ``spans``: the base spans and the accepted proposals that overlap none of them."""
    def accepted(c: Column) -> Column:
        score = sum((_tree_column(t, c) for t in model["trees"]), F.lit(model["start"]))
        limit = F.lit(None).cast("double")
        for g, x in enumerate(model["limits"]):
            if x is not None:
                limit = F.when(c["gen"] == g, F.lit(float(x) - 1e-9)).otherwise(limit)
        return ~c["over"] & F.coalesce(score >= limit, F.lit(False))

    extra = F.transform(F.filter("cand", accepted), lambda c: F.struct(c["start"].alias("start"), (c["gen"] + len(BASE)).alias("kind"), c["end"].alias("end")))
    return cand.withColumn("spans", F.array_sort(F.concat("base", extra)))


def redact(found: DataFrame) -> DataFrame:
    """Replaces the spans in ``text`` by ``[EMAIL]`` and the like; overlapping spans become one mark."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("text")

    def rebuilt(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        done = running(ends, 0, lambda a, b: F.greatest(a, b))
        marked = F.zip_with(spans, done, lambda s, m: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), m.alias("done")))
        pieces = F.transform(
            F.filter(marked, lambda s: s["start"] >= s["done"]),
            lambda s: F.concat(F.substring(text, s["done"] + 1, s["start"] - s["done"]), F.element_at(names, s["kind"] + 1)),
        )
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return found.withColumn("text", F.when(F.size("spans") > 0, let(F.col("spans"), rebuilt)).otherwise(text))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest and all spans of every document.

    Null and empty texts hold nothing; null ids and repeated rows are rows like all others; spans of equal start go by kind; an empty table gives no row.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cand = candidates(docs)
    found = detect(cand, fit(cand))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op6_pii_boosting": op6_pii_boosting}
ORACLES: dict[str, str] = {}
