"""Plot anchors, and repairs of annotations that are nested, doubled or at odds.

The annotated text is a table's text in which each run of twelve or more letters carries its
first four as a gloss, with its next four nested inside, and each run of nine to eleven its first four.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import anchors as P
from ..operators import glosses as G
from ..operators import structure as S
from ..plans.layout import by_key
from .base import query, table
from .text_queries import _docs, _en
from .text_sql import FORMS, SEG

_DEEP, _FLAT = "([A-Za-z]{4})([a-z]{4})([a-z]{4,})", "([A-Za-z]{4})([a-z]{5,7})([^A-Za-zÀ-ÿ]|$)"
_RUN = r"\b[A-Za-z][A-Za-z'’-]*(?:\s+[A-Za-z'’-]+){1,6}\b"
_FUNCTION = "(" + ", ".join(f"'{w}'" for w in P.FUNCTION_WORDS) + ")"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "txt_anchor_phrases",
    f"""WITH x AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, {_sql(P.QUOTED)}, 1), regexp_extract_all(text, {_sql(P.TITLED)}, 1), regexp_extract_all(text, {_sql(_RUN)}))) AS x FROM documents WHERE lang = 'en'),
y AS (SELECT doc_id, unnest(string_split_regex(x, '[/／|]')) AS x FROM x),
z AS (SELECT doc_id, lower(regexp_replace(regexp_replace(trim(x), {_sql(P.OPENING)}, ''), {_sql(P.CLOSING)}, '')) AS a FROM y),
w AS (SELECT DISTINCT doc_id, a, list_filter(string_split_regex(a, '\\s+'), lambda v: v <> '') AS w FROM z WHERE length(a) >= 5 AND regexp_matches(a, '[a-z]')),
k AS (SELECT doc_id, a FROM w WHERE len(w) >= 2 AND regexp_replace(w[1], '[^a-z'']', '', 'g') NOT IN {_FUNCTION} AND regexp_replace(w[-1], '[^a-z'']', '', 'g') NOT IN {_FUNCTION})
SELECT doc_id, a AS anchor FROM k WHERE NOT EXISTS (SELECT 1 FROM k l WHERE l.doc_id = k.doc_id AND length(l.a) > length(k.a) AND contains(l.a, k.a))""",
)
def txt_anchor_phrases(spark, d):
    """The anchors of English documents that no longer anchor contains."""
    return P.maximal(P.phrases(_en(spark, d)))


def deep(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _FLAT, "$1$2（$1）$3"), _DEEP, "$1$2$3（$1（$2））")


def _segments(spark, d):
    return S.segments(_en(spark, d)).select("doc_id", "seg_idx", deep(F.col("body")).alias("body"))


_DEEPSEG = rf"""{SEG}, deep AS (SELECT doc_id, seg_idx, regexp_replace(regexp_replace(body, {_sql(_FLAT)}, '\1\2（\1）\3', 'g'), '{_DEEP}', '\1\2\3（\1（\2））', 'g') AS body FROM seg WHERE lang = 'en'),
flat AS (SELECT doc_id, seg_idx, body AS before, regexp_replace(body, '([A-Za-z])（([^（）]*)（([^（）]*)）([^（）]*)）', '\1（\2\3\4）', 'g') AS body FROM deep)"""
_PIECES = rf"""pieces AS (SELECT doc_id, seg_idx, regexp_extract_all(body, {_sql(G.TOKENS)}) AS l FROM {{0}}),
piece AS (SELECT doc_id, seg_idx, i::INT AS n, l[i + 1] AS piece, nullif(regexp_extract(l[i + 1], '^[A-Za-z][A-Za-z''-]*'), '') AS word, nullif(regexp_extract(l[i + 1], '（([^（）]+)）$', 1), '') AS gloss0 FROM pieces, unnest(range(len(l))) AS t(i)),
tk AS (SELECT doc_id, seg_idx, n, piece, word, CASE WHEN word IS NOT NULL THEN gloss0 END AS gloss, regexp_replace(regexp_replace(regexp_replace(lower(word), '^[''-]+', ''), '[''-]+$', ''), '''s$', '') AS key FROM piece)"""


def _pieces(table_name: str) -> str:
    return _PIECES.replace("{0}", table_name)


def _repair_sql(keep_first: bool) -> str:
    new = "CASE WHEN r > 1 THEN word ELSE word || '（' || first || '）' END" if keep_first else "word || '（' || first || '）'"
    return f"""WITH {_DEEPSEG}, {_pieces('flat')},
nt AS (SELECT *, first_value(gloss) OVER w AS first, row_number() OVER w AS r FROM tk WHERE gloss IS NOT NULL WINDOW w AS (PARTITION BY doc_id, lower(word) ORDER BY seg_idx, n)),
al AS (SELECT doc_id, seg_idx, n, {new} AS p, ({new} <> piece)::INT AS hit FROM nt UNION ALL SELECT doc_id, seg_idx, n, piece, 0 FROM tk WHERE gloss IS NULL)
SELECT doc_id, seg_idx, any_value(f.before) <> any_value(f.body) AS nested, string_agg(p, '' ORDER BY n) AS body, sum(hit)::BIGINT AS changed FROM al JOIN flat f USING (doc_id, seg_idx) GROUP BY ALL"""


@query("ann_repair", _repair_sql(False))
def ann_repair(spark, d):
    """Segments of English documents with flat glosses, each word's as its first one."""
    return G.repair(_segments(spark, d))


@query("ann_repair_first", _repair_sql(True))
def ann_repair_first(spark, d):
    """As ``ann_repair``, and each word annotated once in a document."""
    return G.repair(_segments(spark, d), keep="first")


@query(
    "chk_gloss_issues",
    f"""WITH {_DEEPSEG}, {_pieces('deep')}, s AS (SELECT doc_id, lower(word) AS w, min(seg_idx) AS seg_idx, list_sort(list_distinct(list(gloss))) AS g FROM tk WHERE gloss IS NOT NULL GROUP BY ALL)
SELECT doc_id, seg_idx, 'nested' AS kind, body AS detail FROM flat WHERE body <> before
UNION ALL SELECT doc_id, seg_idx, 'sense-conflict', w || ': ' || array_to_string(g, ' / ') FROM s WHERE len(g) > 1""",
)
def chk_gloss_issues(spark, d):
    """Unclosed and nested glosses, and words with more than one gloss, in English documents."""
    return G.issues(_segments(spark, d))


def _actions(segs):
    """One action for each segment, by its number, on its first word of nine letters or more."""
    word = F.lower(F.regexp_extract("body", "[A-Za-z]{9,}", 0))
    kind = F.element_at(F.array(*map(F.lit, ("insert", "strip", "dedupe", "sense", "flatten", "revert"))), ((F.col("doc_id") + F.col("seg_idx")) % 6 + 1).cast("int"))
    revert = F.col("action") == "revert"
    rows = segs.withColumn("action", kind).where((word != "") | F.col("action").isin("flatten"))
    return rows.select("doc_id", "seg_idx", "action", F.when(revert, F.substring("body", 3, 5)).otherwise(word).alias("word"), F.when(revert, F.lit("[back]")).otherwise(F.lit("sense")).alias("gloss"))


@query(
    "txt_apply_actions",
    f"""WITH {_DEEPSEG}, {_pieces('deep')},
ac AS (SELECT * FROM (SELECT doc_id, seg_idx, body, lower(regexp_extract(body, '[A-Za-z]{{9,}}')) AS word, ['insert', 'strip', 'dedupe', 'sense', 'flatten', 'revert'][((doc_id + seg_idx) % 6 + 1)::INT] AS action FROM deep) WHERE word <> '' OR action = 'flatten'),
tf AS (SELECT tok, {FORMS} AS l FROM (SELECT DISTINCT key AS tok FROM tk WHERE key IS NOT NULL UNION SELECT DISTINCT word FROM ac)),
ft AS (SELECT t.*, a.action, a.word AS want, coalesce(t.key = a.word OR list_contains(x.l, a.word) OR list_contains(y.l, t.key), false) AS fits
  FROM tk t JOIN ac a USING (doc_id, seg_idx) LEFT JOIN tf x ON x.tok = t.key LEFT JOIN tf y ON y.tok = a.word WHERE a.action IN ('insert', 'strip', 'dedupe', 'sense')),
fw AS (SELECT *, min(n) FILTER (fits AND gloss IS NOT NULL) OVER w AS fn, min(n) FILTER (fits AND gloss IS NULL) OVER w AS fb FROM ft WINDOW w AS (PARTITION BY doc_id, seg_idx)),
nw AS (SELECT *, CASE WHEN action = 'insert' AND fn IS NULL AND n = fb OR action = 'sense' AND n = fn THEN word || '（sense）' WHEN fits AND gloss IS NOT NULL AND (action = 'strip' OR action = 'dedupe' AND n > fn) THEN word ELSE piece END AS new FROM fw)
SELECT doc_id, seg_idx, string_agg(new, '' ORDER BY n) AS body, CASE WHEN bool_or(new <> piece) THEN 'ok' WHEN bool_or(fn IS NOT NULL OR action = 'insert' AND fb IS NOT NULL) THEN 'no-op' ELSE 'not-found' END AS status FROM nw GROUP BY ALL
UNION ALL SELECT doc_id, seg_idx, f.body, CASE WHEN f.body <> f.before THEN 'ok' ELSE 'no-op' END FROM flat f JOIN ac USING (doc_id, seg_idx) WHERE action = 'flatten'
UNION ALL SELECT doc_id, seg_idx, body[:strpos(body, body[3:7]) - 1] || '[back]' || body[strpos(body, body[3:7]) + length(body[3:7]):], 'ok' FROM ac WHERE action = 'revert'""",
)
def txt_apply_actions(spark, d):
    """Every segment of English documents after its action, and what came of it.

    Documents are dealt out by their ids before they are cut up, so that segments meet their actions where they are.
    """
    docs = by_key(table(spark, d, "documents").select("doc_id", "lang", "text").where("lang = 'en'"), "doc_id", "text")
    segs = S.segments(docs).select("doc_id", "seg_idx", deep(F.col("body")).alias("body"))
    return G.apply_actions(segs, _actions(segs))
