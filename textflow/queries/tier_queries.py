"""Acceptance of graded tiers, rewrite checks and replaced word forms.

Tiers are documents taken four at a time: ``doc_id div 4`` is the chapter, remainder 0 its source,
1, 2 and 3 its tiers A, M and B. Segments correspond by number. Words of nine or more letters carry a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annot as A
from ..operators import lexicon as L
from ..operators import structure as S
from ..plans.layout import spread
from .annot_queries import _CLEAN, _PATTERN, _noted, noted
from .base import query, table
from .text_queries import _VER, versions
from .text_sql import LEX, RES, SEG, SENT, TOK, TOKENS

NOTE = "（[^）]*）"
GRADIENT = 1.15  # fixed value: B's mean sentence may be this much longer than A's
_NEGATIONS = ("not", "never", "no", "cannot")
_WORD = "[A-Za-z0-9_]+"  # engines differ on word boundaries beside letters beyond ASCII
_NAMES = "[a-z,] ([A-Z][a-z]+)"
_AT = ["chapter", "tier"]


def _once(value: Column) -> Column:
    """A column that is worked out once for a row: a projection would be put together with those behind it and run for each mention."""
    return F.explode_outer(F.array(value))


def _tiers(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang", "text"))
    tier = F.element_at(F.array(*map(F.lit, ("source", "A", "M", "B"))), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    segs = S.segments(docs).select("doc_id", F.expr("doc_id div 4").alias("chapter"), tier.alias("tier"), "seg_idx", _once(noted(F.col("body"))).alias("body"))
    return segs.select("*", _once(F.regexp_replace("body", NOTE, "")).alias("bare")).select("*", _once(F.lower("bare")).alias("clean"))


def _lex(spark, d) -> DataFrame:
    return L.lexicon_of(table(spark, d, "benchmark"))


def _unnoted(spark, d, segs: DataFrame) -> DataFrame:
    """chapter, tier, seg_idx, unnoted: words outside the lexicon that their document explains nowhere."""
    words = F.filter(F.regexp_extract_all("clean", F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 2) | w.isin("a", "i"))
    toks = segs.select("doc_id", *_AT, "seg_idx", F.explode_outer(words).alias("tok")).where("tok IS NOT NULL")
    counts = L.mark(toks, _lex(spark, d)).where("base IS NULL").groupBy("doc_id", *_AT, "seg_idx", "tok").agg(F.count(F.lit(1)).alias("n"))
    explained = A.annotations(segs.select("doc_id", "seg_idx", "body")).select("doc_id", F.col("key").alias("tok")).distinct()
    open_ = counts.join(explained, ["doc_id", "tok"], "left_anti")
    return open_.groupBy(*_AT, "seg_idx").agg(F.sum("n").alias("unnoted"))


def _counted(spark, d, segs: DataFrame) -> DataFrame:
    """chapter, tier, seg_idx and what is counted in a segment, in one row (``segments`` 1) or two (its unnoted words in one of their own), so that sums need no join."""
    words = F.regexp_count("clean", F.lit("[a-z]+"))
    single = F.regexp_count("clean", F.lit(r"(?:^|[^a-z])[b-hj-z](?=[^a-z]|$)"))
    heads = F.transform(F.regexp_extract_all("body", F.lit("([A-Za-z][A-Za-z-]*)" + NOTE), F.lit(1)), F.lower)
    found = F.struct(words.alias("words"), single.alias("single"), heads.alias("heads"), T.sentences(F.col("bare")).alias("sents"))
    per = segs.select(*_AT, "seg_idx", "body", "bare", _once(found).alias("x")).select(
        *_AT, "seg_idx", F.lit(1).alias("segments"), "x.words", (F.col("x.words") - F.col("x.single")).alias("tokens"), F.regexp_count("body", F.lit(NOTE)).alias("notes"),
        F.col("bare").rlike("[一-鿿]").cast("int").alias("foreign"), (F.size("x.heads") - F.size(F.array_distinct("x.heads"))).alias("repeats"),
        F.size("x.sents").alias("sents"), F.regexp_count(F.lower(F.array_join("x.sents", " ")), F.lit("[a-z]+")).alias("sent_words"),
    )
    return per.unionByName(_unnoted(spark, d, segs), allowMissingColumns=True)


def _rates(spark, d, segs: DataFrame) -> DataFrame:
    """A row a tier; avg_sent: words of the mean sentence."""
    per = _counted(spark, d, segs)
    density = F.when(F.col("words") > 0, 100.0 * F.col("notes") / F.col("words")).otherwise(F.lit(0.0))
    worst = F.max_by("seg_idx", F.when(density > 0, F.struct(density, -F.col("seg_idx"))))
    sums = [F.sum(c).alias(c) for c in ("segments", "words", "tokens", "notes", "foreign", "repeats", "sents", "sent_words", "unnoted")]
    return per.groupBy(*_AT).agg(*sums, worst.alias("worst_at")).fillna(0, ["unnoted"]).withColumn("avg_sent", F.try_divide("sent_words", "sents"))


def _suspects(segs: DataFrame) -> DataFrame:
    """Per tier the segments with numbers the source lacks, without its names, or with all its two or more negations gone."""
    source = segs.where("tier = 'source'").select("chapter", "seg_idx", F.col("bare").alias("source"))
    pairs = segs.where("tier <> 'source'").join(source, ["chapter", "seg_idx"])
    runs = lambda c: F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    numbers = lambda c: F.filter(runs(c), lambda w: w.rlike("^[0-9]+$"))
    negations = lambda c: F.size(F.filter(runs(c), lambda w: F.lower(w).isin(*_NEGATIONS)))
    names = F.regexp_extract_all("source", F.lit(_NAMES), F.lit(1))
    lost = F.exists(names, lambda w: ~F.contains(F.col("clean"), F.lower(w)))
    fewer = (negations("source") >= 2) & (negations("clean") == 0)
    of = [(F.size(F.array_except(numbers("clean"), numbers("source"))) > 0).alias("invented"), lost.alias("lost"), fewer.alias("turned")]
    return pairs.select(*_AT, *of).groupBy(*_AT).agg(*(F.count_if(c).alias(c) for c in ("invented", "lost", "turned")))


_T = f"""{SEG.replace('seg AS', 'raw AS', 1)},
segs AS (SELECT *, lower(bare) AS clean FROM (SELECT *, regexp_replace(body, '{NOTE}', '', 'g') AS bare FROM (SELECT doc_id, lang, doc_id // 4 AS chapter, ['source', 'A', 'M', 'B'][(doc_id % 4) + 1] AS tier, seg_idx, {_noted('body')} AS body FROM raw WHERE doc_id IS NOT NULL))),
seg AS (SELECT doc_id, lang, seg_idx, bare AS body FROM segs){SENT[len(SEG):]},
tok AS (SELECT doc_id, chapter, tier, seg_idx, unnest(list_filter(regexp_extract_all(clean, '[a-z]+'), lambda w: length(w) >= 2 OR w IN ('a', 'i'))) AS tok FROM segs), {LEX}, {RES},
keys AS (SELECT DISTINCT doc_id, {_CLEAN.format('w')} AS tok FROM (SELECT doc_id, unnest(regexp_extract_all(body, '{_PATTERN}', 1)) AS w FROM segs)),
unn AS (SELECT chapter, tier, seg_idx, count(*) AS n FROM tok WHERE tok IN (SELECT tok FROM res WHERE base IS NULL) AND (doc_id, tok) NOT IN (SELECT (doc_id, tok) FROM keys WHERE tok IS NOT NULL) GROUP BY ALL),
lens AS (SELECT doc_id // 4 AS chapter, ['source', 'A', 'M', 'B'][(doc_id % 4) + 1] AS tier, sum(len(regexp_extract_all(lower(sent), '[a-z]+'))) / count(*) AS avg_sent FROM sent GROUP BY ALL),
per AS (SELECT chapter, tier, seg_idx, len(regexp_extract_all(clean, '[a-z]+')) AS words, len(regexp_extract_all(body, '{NOTE}')) AS notes, list_transform(regexp_extract_all(body, '([A-Za-z][A-Za-z-]*){NOTE}', 1), lambda w: lower(w)) AS heads, regexp_matches(bare, '[一-鿿]') AS han FROM segs),
rate AS (SELECT chapter, tier, count(*) AS segments, sum(words) AS words, sum(notes) AS notes, sum(len(heads) - len(list_distinct(heads))) AS repeats, count_if(han) AS "foreign", arg_min(seg_idx, (-100.0 * notes / words, seg_idx)) FILTER (notes > 0 AND words > 0) AS worst_at FROM per GROUP BY ALL),
toks AS (SELECT chapter, tier, count(*) AS tokens FROM tok GROUP BY ALL),
open AS (SELECT chapter, tier, sum(n) AS unnoted FROM unn GROUP BY ALL),
tiers AS (SELECT r.*, coalesce(t.tokens, 0) AS tokens, coalesce(o.unnoted, 0) AS unnoted, l.avg_sent FROM rate r LEFT JOIN toks t USING (chapter, tier) LEFT JOIN open o USING (chapter, tier) LEFT JOIN lens l USING (chapter, tier))"""
_PCT = "100.0 * unnoted / greatest(tokens, 1)"
_NEG = f"len(list_filter(regexp_extract_all({{0}}, '{_WORD}'), lambda w: lower(w) IN {_NEGATIONS}))"
_NUM = f"list_filter(regexp_extract_all({{0}}, '{_WORD}'), lambda w: regexp_matches(w, '^[0-9]+$'))"
_SUS = rf"""sus AS (SELECT t.chapter, t.tier, count_if(len(list_filter({_NUM.format('t.clean')}, lambda x: NOT list_contains({_NUM.format('s.bare')}, x))) > 0) AS invented,
count_if(len(list_filter(regexp_extract_all(s.bare, '{_NAMES}', 1), lambda x: NOT contains(t.clean, lower(x)))) > 0) AS lost,
count_if({_NEG.format('lower(s.bare)')} >= 2 AND {_NEG.format('t.clean')} = 0) AS turned
FROM segs t JOIN segs s ON s.chapter = t.chapter AND s.seg_idx = t.seg_idx AND s.tier = 'source' WHERE t.tier <> 'source' GROUP BY ALL)"""


@query(
    "acc_tier_report",
    f"WITH {_T}, {_SUS} SELECT chapter, tier, segments, tokens, unnoted, {_PCT} AS rate_pct, notes, 100.0 * notes / greatest(words, 1) AS per_100, worst_at, avg_sent, repeats, \"foreign\", coalesce(invented, 0) AS invented, coalesce(lost, 0) AS lost, coalesce(turned, 0) AS turned FROM tiers LEFT JOIN sus USING (chapter, tier) WHERE tier <> 'source'",
)
def acc_tier_report(spark, d):
    """Each tier's share of unexplained unknown words, notes per 100 words and their densest segment, repeated notes, and suspects against the source (rates not rounded)."""
    segs = _tiers(spark, d)
    rows = _rates(spark, d, segs.where("tier <> 'source'")).join(_suspects(segs), _AT, "left").fillna(0, ["invented", "lost", "turned"])
    pct, per = F.expr(_PCT), F.expr("100.0D * notes / greatest(words, 1)")
    return rows.select(*_AT, "segments", "tokens", "unnoted", pct.cast("double").alias("rate_pct"), "notes", per.alias("per_100"), "worst_at", "avg_sent", "repeats", "foreign", "invented", "lost", "turned")


def _verdicts(spark, d) -> DataFrame:
    per = _counted(spark, d, _tiers(spark, d).where("tier <> 'source'"))
    counted = ("segments", "tokens", "unnoted", "sents", "sent_words")
    each = [F.coalesce(F.sum(F.when(F.col("tier") == t, F.col(c))), F.lit(0)).alias(f"{t}_{c}") for t in "AMB" for c in counted]
    places = per.groupBy("chapter", "seg_idx").agg(*each)
    sums = [F.sum(f"{t}_{c}").alias(f"{t}_{c}") for t in "AMB" for c in counted]
    wide = places.groupBy("chapter").agg(*sums, F.count_if(F.expr("A_segments > 0 AND B_unnoted > A_unnoted")).alias("inversions"))
    is_there = lambda t: F.col(f"{t}_segments") > 0
    pct = lambda t: F.when(is_there(t), 100.0 * F.col(f"{t}_unnoted") / F.greatest(F.col(f"{t}_tokens"), F.lit(1)))
    avg = lambda t: F.try_divide(f"{t}_sent_words", f"{t}_sents")
    whole = lambda c: sum((F.col(f"{t}_{c}") for t in "MB"), F.col(f"A_{c}")).alias(c)
    aligned = (F.col("A_segments") == F.col("M_segments")) & (F.col("M_segments") == F.col("B_segments"))
    return wide.select(
        "chapter", F.concat_ws(",", *(F.when(is_there(t), t) for t in "ABM")).alias("tiers"), whole("tokens"), whole("unnoted"),
        F.coalesce((pct("B") < pct("M")) & (pct("M") < pct("A")), F.lit(False)).alias("ordered"),
        F.try_divide(F.coalesce(avg("B"), F.lit(0.0)), avg("A")).alias("ratio"), aligned.alias("aligned"), "inversions",
    )


_V = f"""{_T}, w AS (SELECT chapter, string_agg(tier, ',' ORDER BY tier) AS tiers, sum(tokens) AS tokens, sum(unnoted) AS unnoted,
max(CASE tier WHEN 'A' THEN {_PCT} END) AS a, max(CASE tier WHEN 'M' THEN {_PCT} END) AS m, max(CASE tier WHEN 'B' THEN {_PCT} END) AS b,
coalesce(max(CASE tier WHEN 'B' THEN avg_sent END), 0) / max(CASE tier WHEN 'A' THEN avg_sent END) AS ratio, count(*) = 3 AND min(segments) = max(segments) AS aligned FROM tiers WHERE tier <> 'source' GROUP BY chapter),
inv AS (SELECT chapter, count(*) AS inversions FROM unn b WHERE tier = 'B' AND EXISTS (FROM segs s WHERE s.chapter = b.chapter AND s.seg_idx = b.seg_idx AND s.tier = 'A') AND n > coalesce((SELECT max(a.n) FROM unn a WHERE a.tier = 'A' AND a.chapter = b.chapter AND a.seg_idx = b.seg_idx), 0) GROUP BY chapter),
ver AS (SELECT chapter, tiers, tokens, unnoted, coalesce(b < m AND m < a, false) AS ordered, ratio, aligned, coalesce(inversions, 0) AS inversions FROM w LEFT JOIN inv USING (chapter))"""


@query("acc_chapter_verdict", f"WITH {_V} SELECT chapter, ordered, ratio, coalesce(ratio <= {GRADIENT}, true) AS gradual, aligned, inversions FROM ver")
def acc_chapter_verdict(spark, d):
    """Whether rates fall from A to B, sentences don't grow, segments correspond; and where B is harder than A in a segment."""
    return _verdicts(spark, d).select("chapter", "ordered", "ratio", F.coalesce(F.col("ratio") <= GRADIENT, F.lit(True)).alias("gradual"), "aligned", "inversions")


_STATE = f"CASE WHEN tiers <> 'A,B,M' THEN 'missing' WHEN ordered AND aligned AND inversions = 0 AND coalesce(ratio <= {GRADIENT}, true) THEN 'accepted' ELSE 'check' END"
_MISSING = "concat(CASE WHEN tiers LIKE '%A%' THEN '' ELSE 'A' END, CASE WHEN tiers LIKE '%M%' THEN '' ELSE 'M' END, CASE WHEN tiers LIKE '%B%' THEN '' ELSE 'B' END)"


@query("acc_cross_tier_summary", f"WITH {_V} SELECT chapter, tiers, {_MISSING} AS missing, tokens, unnoted, {_STATE} AS verdict FROM ver")
def acc_cross_tier_summary(spark, d):
    """Each chapter's tiers, those that are missing, its sums and whether it may go out."""
    return _verdicts(spark, d).select("chapter", "tiers", F.expr(_MISSING).alias("missing"), "tokens", "unnoted", F.expr(_STATE).alias("verdict"))


_CLASS = "CASE WHEN {0} LIKE '%ing' THEN 'ing' WHEN {0} LIKE '%ed' THEN 'ed' WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN 's' ELSE 'base' END"


@query("fn_morph_mismatch", f"WITH {TOK}, {LEX}, {RES} SELECT tok, base, {_CLASS.format('tok')} AS had, {_CLASS.format('base')} AS has FROM res WHERE {_CLASS.format('tok')} <> {_CLASS.format('base')} AND base IS NOT NULL")
def fn_morph_mismatch(spark, d):
    """Replacements of a word by its lexicon word that change the class of its ending."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    types = S.tokens(S.sentences(docs)).select("tok").distinct()
    pairs = L.resolve(types, _lex(spark, d)).where("base IS NOT NULL")
    return pairs.select("tok", "base", F.expr(_CLASS.format("tok")).alias("had"), F.expr(_CLASS.format("base")).alias("has")).where("had <> has")


@query(
    "gate_rewrite",
    f"""WITH {_VER}, {LEX}, w AS (SELECT pair_id, turn, tok, max(b) AS b, max(c) AS c FROM (SELECT pair_id, turn, unnest({TOKENS.format('base')}) AS tok, 1 AS b, 0 AS c FROM ver UNION ALL SELECT pair_id, turn, unnest({TOKENS.format('cur')}), 0, 1 FROM ver) GROUP BY ALL),
tok AS (SELECT DISTINCT tok FROM w), {RES}, f AS (SELECT pair_id, tok, min(turn) AS first FROM w WHERE b = 1 AND length(tok) >= 9 GROUP BY ALL),
j AS (SELECT w.*, r.base IS NULL AND length(w.tok) > 1 AS oov, coalesce(f.first < w.turn, false) AS covered FROM w JOIN res r USING (tok) LEFT JOIN f USING (pair_id, tok))
SELECT pair_id, turn, count_if(oov AND NOT covered AND c = 1 AND b = 0) AS sentence_must, count_if(oov AND NOT covered) AS segment_must, count_if(covered AND c = 1 AND length(tok) >= 9) AS reannotated FROM j GROUP BY ALL""",
)
def gate_rewrite(spark, d):
    """Words that a rewrite must explain: as a sentence those it brings in, as a segment those of both texts; without those explained in an earlier turn, which it must not explain again."""
    v = versions(spark, d)
    side = lambda c, b: v.select("pair_id", "turn", F.explode(F.array_distinct(T.tokens(F.col(c)))).alias("tok"), F.lit(b).alias("b"), F.lit(1 - b).alias("c"))
    words = side("base", 1).unionByName(side("cur", 0)).groupBy("pair_id", "turn", "tok").agg(F.max("b").alias("b"), F.max("c").alias("c"))
    known = L.resolve(words.select("tok").distinct(), _lex(spark, d))
    first = words.where("b = 1 AND length(tok) >= 9").groupBy("pair_id", "tok").agg(F.min("turn").alias("first"))
    rows = words.join(known, "tok").join(first, ["pair_id", "tok"], "left")
    oov, covered = F.col("base").isNull() & (F.length("tok") > 1), F.coalesce(F.col("first") < F.col("turn"), F.lit(False))
    must = oov & ~covered
    return rows.groupBy("pair_id", "turn").agg(
        F.count_if(must & (F.col("c") == 1) & (F.col("b") == 0)).alias("sentence_must"),
        F.count_if(must).alias("segment_must"),
        F.count_if(covered & (F.col("c") == 1) & (F.length("tok") >= 9)).alias("reannotated"),
    )
