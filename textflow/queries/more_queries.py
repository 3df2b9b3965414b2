"""Gates over sentence pairs, marks, plot weights, form profiles and annotation rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from .base import query, table
from .ledger_queries import DEC, LATEST, both
from .text_queries import _VER, _docs, _tok, versions
from .text_sql import CONTENT, SEG, TOK, WC

# --- pairs of sentences

_PAIRS = f"""{_VER}, b AS (SELECT pair_id, turn, i::INT AS at, l[i + 1] AS s FROM (SELECT pair_id, turn, string_split(regexp_replace(base, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ver) x, unnest(range(len(l))) AS t(i)),
 c AS (SELECT pair_id, turn, i::INT AS at, l[i + 1] AS s FROM (SELECT pair_id, turn, string_split(regexp_replace(cur, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ver) x, unnest(range(len(l))) AS t(i))"""


def _sentence_sides(spark, d):
    v = versions(spark, d)
    cut = lambda c: v.select("pair_id", "turn", F.posexplode(F.split(F.regexp_replace(c, "([.!?]) ", "$1\u0001"), "\u0001")).alias("at", "s"))
    return cut("base"), cut("cur")


@query(
    "sim_sentence_pairs",
    f"""WITH {_PAIRS}, bw AS (SELECT pair_id, turn, "at" AS pos, len(w) AS n, unnest(w) AS x FROM (SELECT pair_id, turn, "at", {CONTENT.format('s')} AS w FROM b) y), cw AS (SELECT pair_id, turn, "at" AS pos, len(w) AS n, unnest(w) AS x FROM (SELECT pair_id, turn, "at", {CONTENT.format('s')} AS w FROM c) y),
 j AS (SELECT bw.pair_id, bw.turn, bw.pos AS base_at, cw.pos AS cur_at, count(*) / (bw.n + cw.n - count(*)) AS sim FROM bw JOIN cw ON bw.pair_id = cw.pair_id AND bw.turn = cw.turn AND bw.x = cw.x GROUP BY bw.pair_id, bw.turn, bw.pos, cw.pos, bw.n, cw.n),
 r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn, base_at ORDER BY sim DESC, cur_at) AS rb, row_number() OVER (PARTITION BY pair_id, turn, cur_at ORDER BY sim DESC, base_at) AS rc FROM j WHERE sim > 0.1)
SELECT pair_id, turn, base_at, cur_at, sim FROM r WHERE rb = 1 AND rc = 1""",
)
def sim_sentence_pairs(spark, d):
    """Sentences that are each other's best match by shared content words."""
    b, c = _sentence_sides(spark, d)
    words = lambda df, side: df.withColumn("w", T.content_words(F.col("s"))).select("pair_id", "turn", F.col("at").alias(f"{side}_at"), F.size("w").alias(f"n_{side}"), F.explode("w").alias("x"))
    j = words(b, "base").join(words(c, "cur"), ["pair_id", "turn", "x"]).groupBy("pair_id", "turn", "base_at", "cur_at", "n_base", "n_cur").agg(F.count(F.lit(1)).alias("k"))
    j = j.withColumn("sim", F.col("k") / (F.col("n_base") + F.col("n_cur") - F.col("k"))).where("sim > 0.1")
    best = lambda one, other: F.row_number().over(Window.partitionBy("pair_id", "turn", one).orderBy(F.desc("sim"), other))
    return j.withColumn("rb", best("base_at", "cur_at")).withColumn("rc", best("cur_at", "base_at")).where("rb = 1 AND rc = 1").select("pair_id", "turn", "base_at", "cur_at", "sim")


@query("gate_sentence_edit", rf"WITH {_PAIRS} SELECT b.pair_id, b.turn, b.at, {WC.format('b.s')} < 8 OR ({WC.format('c.s')} / {WC.format('b.s')} BETWEEN 0.5 AND 1.6) AS length_ok, len(list_filter(regexp_extract_all(b.s, '\d+'), lambda x: NOT list_contains(regexp_extract_all(c.s, '\d+'), x))) = 0 AS facts_ok FROM b JOIN c ON b.pair_id = c.pair_id AND b.turn = c.turn AND b.at = c.at")
def gate_sentence_edit(spark, d):
    b, c = _sentence_sides(spark, d)
    j = b.join(c.withColumnRenamed("s", "t"), ["pair_id", "turn", "at"])
    nb, nc, digits = T.word_count(F.col("s")), T.word_count(F.col("t")), F.lit(r"\d+")
    lost = F.array_except(F.regexp_extract_all("s", digits, F.lit(0)), F.regexp_extract_all("t", digits, F.lit(0)))
    return j.select("pair_id", "turn", "at", ((nb < 8) | (nc / nb).between(0.5, 1.6)).alias("length_ok"), (F.size(lost) == 0).alias("facts_ok"))


@query("ver_plot_weight", rf"""WITH {SEG}, m AS (SELECT doc_id, seg_idx, len(regexp_extract_all(body, '"[^"]+"')) AS anchors, len(regexp_extract_all(body, '[a-z,] [A-Z][a-z]+')) AS names, len(regexp_extract_all(body, '\d+')) AS numbers, len(regexp_extract_all(lower(body), '\b(?:because|so|but|then)\b')) AS causal, (seg_idx = 1)::INT AS edge FROM seg WHERE lang = 'en'), w AS (SELECT doc_id, seg_idx, least(1.0, (3 * anchors + 1.2 * names + numbers + 0.8 * causal + 0.6 * edge) / 7.2) AS w FROM m) SELECT doc_id, seg_idx, round(w, 6) AS weight, CASE WHEN round(w, 6) >= 0.55 THEN 'high' WHEN round(w, 6) >= 0.25 THEN 'mid' ELSE 'low' END AS level FROM w""")
def ver_plot_weight(spark, d):
    c = lambda p, col="body": F.regexp_count(col, F.lit(p))
    raw = 3 * c('"[^"]+"') + 1.2 * c("[a-z,] [A-Z][a-z]+") + c(r"\d+") + 0.8 * F.regexp_count(F.lower("body"), T.ascii_bounds(r"\b(?:because|so|but|then)\b")) + 0.6 * (F.col("seg_idx") == 1).cast("int")
    w = F.round(F.least(F.lit(1.0), raw / 7.2), 6)
    return S.segments(_docs(spark, d).where("lang = 'en'")).select("doc_id", "seg_idx", w.alias("weight"), F.when(w >= 0.55, "high").when(w >= 0.25, "mid").otherwise("low").alias("level"))


@query("gate_stage_scan", f"WITH {SEG} SELECT doc_id, seg_idx, {WC.format('body')} > 120 AS vocab, {WC.format('body')} > 60 AS syntax, NOT regexp_matches(trim(body), '[.!?]$') AS coherence FROM seg")
def gate_stage_scan(spark, d):
    n = T.word_count(F.col("body"))
    return S.segments(_docs(spark, d)).select("doc_id", "seg_idx", (n > 120).alias("vocab"), (n > 60).alias("syntax"), (~F.trim("body").rlike("[.!?]$")).alias("coherence"))


@query("ann_first_only", r"SELECT page_id, lower(w) AS key, min(p)::INT AS first_at, count(*) AS n FROM (SELECT page_id, i AS p, l[i + 1] AS w FROM (SELECT page_id, regexp_extract_all(html, '>([A-Za-z]+)</a>', 1) AS l FROM pages) x, unnest(range(len(l))) AS t(i)) y GROUP BY page_id, lower(w)")
def ann_first_only(spark, d):
    words = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(">([A-Za-z]+)</a>"), F.lit(1))).alias("p", "w"))
    return words.groupBy("page_id", F.lower("w").alias("key")).agg(F.min("p").alias("first_at"), F.count(F.lit(1)).alias("n"))


# --- ledgers

both("con_attach_origin", f"WITH {DEC}, {LATEST}, o AS (SELECT p_partkey AS item, p_size % 3 AS tier, min(p_brand) AS origin FROM @part GROUP BY p_partkey, p_size % 3), a AS (SELECT p_partkey AS item, min(p_type) AS origin FROM @part GROUP BY p_partkey) SELECT l.item, coalesce(o.origin, a.origin) AS origin FROM latest l LEFT JOIN o ON o.item = l.item AND o.tier = l.teacher % 3 LEFT JOIN a ON a.item = l.item")
both("led_marks_remap", "WITH p AS (SELECT doc_id, substr(text, 1, 24) AS prefix FROM @documents), u AS (SELECT prefix, count(*) AS n, min(doc_id) AS doc_id FROM p GROUP BY prefix) SELECT p.doc_id, CASE WHEN u.n = 1 THEN 'moved' ELSE 'kept' END AS state, u.doc_id AS target FROM p JOIN u ON u.prefix = p.prefix")
both("gate_patches_merge", f"WITH {DEC}, {LATEST} SELECT d.doc_id, CASE WHEN l.kind IN ('accept', 'edit') AND length(d.text) > 100 THEN 'merged' WHEN l.kind IS NULL THEN 'unchanged' ELSE 'blocked' END AS verdict FROM @documents d LEFT JOIN latest l ON l.item = d.doc_id")
both("gate_recap", f"WITH {DEC} SELECT item, CASE WHEN count_if(kind = 'false-positive') > 5 THEN 'fact' WHEN count_if(kind = 'reject') > 5 THEN 'structure' ELSE 'difficulty' END AS class, count_if(kind = 'accept') AS kept, count_if(kind = 'edit') AS supported FROM dec GROUP BY item")
both("gate_round2_targets", f"WITH {DEC}, h AS (SELECT item, count_if(kind = 'reject') AS hard FROM dec GROUP BY item) SELECT d.doc_id, h.hard >= 2 AS flagged FROM @documents d JOIN h ON h.item = d.doc_id WHERE h.hard >= 2 OR d.text LIKE '% the %'")
both("fn_chapter_number", "SELECT page_id, try_cast(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS chapter FROM @pages")
