"""Mixing to target weights by soft membership, in DataFrame expressions only.

A naive Bayes classifier learnt from a labelled table (doc_id, domain) predicts each
document's posterior over the domains. Nonnegative document rates are then fitted by
projected-gradient least squares, so that the expected token total of each domain, the sum of
rate x tokens x posterior, meets its target:

    minimise  F(r) = 1/2 sum_k (got_k(r) - want_k)^2 / start_k   over r_i >= least

start_k being what domain k has at rate 1. With documents weighed by their tokens the gradient
at document i is sum_k posterior_ik (got_k - want_k) / start_k, and its Lipschitz constant is 1
(the domains' overlap matrix has rows that add up to 1), so steps of length 1, each followed by
the projection, never increase F. Each step is one distributed aggregation. The gradient reaches
a document only through its posterior, so documents of one posterior (to 1 / STEPS) are summed
up before. What the targets ask for, what the rates give and the largest relative difference are
returned.

A rate of 1.4 writes a document once, and with probability 0.4 (by a hash of the document)
once more. Rates are nonnegative; with ``least`` = 1 no document is dropped, and targets are
met by repeating what is short of its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 10_000  # labelled rows that the classifier is fitted on, at most
WORDS, SALTS = 96, 32  # indicator words a domain
STEPS = 1_000_000  # posteriors are rounded to 1 / STEPS
TEMPERATURE = 0.7  # default targets: observed shares to this power
LEAST = 0.0
ROUNDS, TOLERANCE = 200, 1e-3
STALLED = 10  # rounds after which the risk has to be a thousandth less, or what is left is out of reach
WRITTEN = 10  # rounds after which rates are written
CELL_ROWS = 20_000  # of posteriors in a task


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n\t\r]+")


def fit(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Domains, priors and word weights from at most ``sample_rows`` labelled documents.

    Rows with a null id or domain are left out; an id with two domains keeps the smaller. With
    no labelled row there is one domain, ``all``.
    """
    rows = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    seen = texts.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''")
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return {"domains": ["all"], "prior": [0.0], "weights": {}}
    n = sum(sizes.values())
    counts = seen.groupBy("word").pivot("domain", domains).count().na.fill(0)
    column = lambda d: F.col("`" + d.replace("`", "``") + "`")
    total = sum((column(d) for d in domains), F.lit(0))
    gain = F.array(*(F.struct((column(d) * F.log((column(d) + 1.0) / (sizes[d] + 2.0) / ((total - column(d) + 1.0) / (n - sizes[d] + 2.0)))).alias("gain"), F.lit(i).alias("d")) for i, d in enumerate(domains)))
    ranked = counts.where(total >= 5).select("word", F.array(*map(column, domains)).alias("n"), F.explode(gain).alias("g"))
    # first within salts, so that a domain is no single task
    best = Window.partitionBy("g.d", F.pmod(F.xxhash64("word"), F.lit(SALTS))).orderBy(F.desc("g.gain"), "word")
    ranked = ranked.withColumn("r", F.row_number().over(best)).where((F.col("r") <= WORDS) & (F.col("g.gain") > 0))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("g.d").orderBy(F.desc("g.gain"), "word"))).where((F.col("r") <= WORDS) & (F.col("g.gain") > 0))
    weights = {}
    for r in ranked.select("word", "n").distinct().collect():  # WORDS rows a domain at most
        p = [(x + 0.5) / (sizes[d] + 1.0) for x, d in zip(r["n"], domains)]
        mean = sum(map(math.log, p)) / len(p)
        weights[r["word"]] = [math.log(x) - mean for x in p]
    return {"domains": domains, "prior": [math.log(sizes[d] / n) for d in domains], "weights": weights}


def with_posterior(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``n_tokens`` (words parted by white space) and ``steps``: the rounded posterior as counts of 1 / STEPS for each domain."""
    k = len(model["domains"])
    prior = F.array(*map(F.lit, model["prior"]))
    df = docs.withColumn("__w", _words(F.col("text")))
    df = df.withColumn("n_tokens", F.size(F.filter("__w", lambda w: w != "")).cast("long"))
    if model["weights"]:
        known = F.array(*(F.lit(w) for w in sorted(model["weights"])))
        table = F.create_map(*(x for w in sorted(model["weights"]) for x in (F.lit(w), F.array(*map(F.lit, model["weights"][w])))))
        hits = F.array_intersect("__w", known)
        logits = F.aggregate(hits, prior, lambda a, w: F.zip_with(a, table[w], lambda x, y: x + y))
    else:
        logits = prior

    def softmax(x: Column) -> Column:
        top = F.array_max(x)
        e = lambda v, t: F.exp(v - t)
        return _let(top, lambda t: _let(F.transform(x, lambda v: e(v, t)), lambda es: _let(F.aggregate(es, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(es, lambda v: F.round(v / s * STEPS).cast("int")))))

    assert k == len(model["prior"])
    return df.withColumn("steps", _let(logits, softmax)).drop("__w")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _share(steps: Column, i: int) -> Column:
    return F.element_at(steps, i + 1) / F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def rate(steps: Column, history: list[list[float]], least: float, start: Column | None = None) -> Column:
    """A document's rate after the steps taken so far: r <- max(least, r - sum_k posterior_k x step_k)."""
    start = F.lit(1.0) if start is None else start
    if not history:
        return start
    errors = F.array(*(F.array(*map(F.lit, e)) for e in history))
    total = F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def step(r: Column, e: Column) -> Column:
        move = F.aggregate(F.zip_with(steps, e, lambda s, x: s * x), F.lit(0.0), lambda a, b: a + b) / total
        return F.greatest(F.lit(float(least)), r - move)

    return F.aggregate(errors, start, step)


def solve(cells: DataFrame, domains: list[str], targets: dict[str, float] | None, least: float = LEAST) -> dict:
    """Projected-gradient steps over (steps, tokens).

    ``targets``: weights by domain; default: observed shares to the power 0.7. They divide the
    tokens that there are; with a lower bound above 0 that no document may fall under, the
    smallest total at which no domain has to shrink below it.
    """
    k = len(domains)
    cells = cells.withColumn("rate", F.lit(1.0))

    def totals(history: list[list[float]]) -> list[float]:
        nonlocal cells
        r = rate(F.col("steps"), history[(len(history) - 1) // WRITTEN * WRITTEN :] if history else [], least, F.col("rate"))
        if history and len(history) % WRITTEN == 0:  # rates so far are written, so that plans stay short
            cells = common.materialize(cells.withColumn("rate", r), "cells")
            r = F.col("rate")
        got = cells.agg(*(F.coalesce(F.sum(r * F.col("tokens") * _share(F.col("steps"), i)), F.lit(0.0)).alias(f"t{i}") for i in range(k))).first()
        return [float(x) for x in got]

    start = totals([])
    if targets is None:
        targets = {d: (s / max(1.0, sum(start))) ** TEMPERATURE for d, s in zip(domains, start)}
    weight = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    norm = sum(w for w, s in zip(weight, start) if s > 0) or 1.0
    weight = [w / norm if s > 0 else 0.0 for w, s in zip(weight, start)]
    whole = max([sum(start), *(least * s / w for s, w in zip(start, weight) if w > 0)])
    want = [w * whole for w in weight]
    history: list[list[float]] = []
    now, left = start, []
    residual = lambda got: max((abs(g - w) / w if w > 0 else g / s for g, w, s in zip(got, want, start) if s > 0), default=0.0)
    while residual(now) >= TOLERANCE and len(history) < ROUNDS:
        left.append(sum((g - w) ** 2 / s for g, w, s in zip(now, want, start) if s > 0))
        if len(left) > STALLED and left[-1] > 0.999 * left[-1 - STALLED]:
            break
        history.append([(g - w) / s if s > 0 else 0.0 for g, w, s in zip(now, want, start)])
        now = totals(history)
    return {"history": history, "want": want, "got": now, "start": start, "residual": residual(now)}


def plan(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, least: float = LEAST) -> tuple[DataFrame, dict]:
    """``docs`` with n_tokens, steps, rate and n_copies (which replace columns of these names), and what was fitted.

    Null and empty texts have no tokens and the prior as posterior. Null ids and repeated rows
    are rows like all others; equal (doc_id, text) get equal numbers of copies. An empty table
    gives an empty one.
    """
    model = fit(docs, labelled)
    known = with_posterior(docs, model)
    cells = common.materialize(known.groupBy("steps").agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")
    cells = common.materialize(cells.coalesce(1 + cells.count() // CELL_ROWS), "cells")
    fitted = solve(cells, model["domains"], targets, least)
    known = known.withColumn("rate", rate(F.col("steps"), fitted["history"], least))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1_000_003)) / 1_000_003.0
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return known.withColumn("n_copies", copies), model | fitted


def by_language(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The labelled table of this corpus: the documents that ``labels`` lists, with their language as domain."""
    ids = common.table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")


def op8_mixing_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document, language shares moved to the power 0.7.

    ``target_tokens`` and ``expected_tokens`` are what its domain should have and what the rates give it.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, fitted = plan(docs, by_language(spark, sf_dir, docs))
    best = F.array_position("steps", F.array_max("steps")).cast("int")
    return out.select(
        "doc_id",
        "n_tokens",
        F.element_at(F.array(*map(F.lit, fitted["domains"])), best).alias("domain"),
        F.to_json(F.map_from_arrays(F.array(*map(F.lit, fitted["domains"])), F.transform("steps", lambda s: F.round(s / F.aggregate("steps", F.lit(0), lambda a, b: a + b), 6)))).alias("posterior"),
        "rate",
        "n_copies",
        F.element_at(F.array(*map(F.lit, fitted["want"])), best).alias("target_tokens"),
        F.element_at(F.array(*map(F.lit, fitted["got"])), best).alias("expected_tokens"),
    )


QUERIES = {"op8_mixing_soft": op8_mixing_soft}
ORACLES: dict[str, str] = {}
