"""Experiment cells over conversations: a user's text is the source, the answer its first version, the answer after next the final one.

First versions annotate words of eleven letters and more, final ones those of nine and more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annot as A
from ..operators import experiment as E
from ..operators import lexicon as L
from .base import query, table
from .text_sql import FORMS, LEX, RES, TOKENS

_FIRST, _FINAL = "([A-Za-z]{4})([a-z]{7,})", "([A-Za-z]{4})([a-z]{5,})"
_PATTERN = A.PATTERN.replace("'", "''")
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(word), '^[''-]+', ''), '[''-]+$', ''), '''s$', '')"


@query(
    "exp_cell_metrics",
    rf"""WITH t AS (SELECT conv_id, turn, role, any_value(text) AS text FROM conversations GROUP BY ALL),
sg AS (SELECT s.conv_id % 4 AS cell, s.conv_id * 100000 + s.turn AS ord, s.text AS source, regexp_replace(a.text, '{_FIRST}', '\1\2（\1）', 'g') AS first, regexp_replace(b.text, '{_FINAL}', '\1\2（\1）', 'g') AS final
  FROM (SELECT * FROM t WHERE role = 'user') s LEFT JOIN (SELECT * FROM t WHERE role = 'assistant') a ON a.conv_id = s.conv_id AND a.turn = s.turn + 1 LEFT JOIN (SELECT * FROM t WHERE role = 'assistant') b ON b.conv_id = s.conv_id AND b.turn = s.turn + 3),
x AS (SELECT cell, ord, source, 'gen' AS kind, coalesce(first, final) AS text FROM sg WHERE final IS NOT NULL UNION ALL SELECT cell, ord, source, 'fin', final FROM sg WHERE final IS NOT NULL),
tok AS (SELECT DISTINCT cell, ord, kind, unnest(list_concat(coalesce({TOKENS.format('source')}, []), {TOKENS.format(f"regexp_replace(text, '{_PATTERN}', chr(92) || '1', 'g')")})) AS tok FROM x),
{LEX}, {RES},
fm AS (SELECT tok, unnest({FORMS}) AS form FROM types),
must AS (SELECT cell, ord, kind, tok, form FROM tok JOIN res USING (tok) JOIN fm USING (tok) WHERE base IS NULL AND length(tok) > 1),
nt AS (SELECT cell, ord, kind, {_KEY} AS tok FROM (SELECT cell, ord, kind, unnest(regexp_extract_all(text, '{_PATTERN}', 1)) AS word FROM x)),
nf AS (SELECT cell, ord, kind, tok AS key, unnest({FORMS}) AS form FROM nt),
pf AS (SELECT cell, ord, kind, unnest({FORMS}) AS form FROM (SELECT cell, ord, kind, unnest(string_split(tok, '-')) AS tok FROM nt)),
own AS (SELECT cell, ord, kind, form FROM nf UNION SELECT cell, ord, kind, form FROM pf),
lg AS (SELECT cell, form, min(ord) AS since FROM nf WHERE kind = 'fin' GROUP BY ALL),
told AS (SELECT m.cell, m.ord, m.kind, tok, min(since) AS since, count(o.form) > 0 AS has FROM must m LEFT JOIN lg ON lg.cell = m.cell AND lg.form = m.form LEFT JOIN own o ON o.cell = m.cell AND o.kind = m.kind AND o.ord = m.ord AND o.form = m.form GROUP BY ALL),
sm AS (SELECT cell, coalesce(count(*) FILTER (kind = 'gen' AND has) / nullif(count(*) FILTER (kind = 'gen'), 0), 1) AS g, coalesce(count(*) FILTER (kind = 'fin' AND has) / nullif(count(*) FILTER (kind = 'fin'), 0), 1) AS f FROM told WHERE since IS NULL OR since >= ord GROUP BY cell),
dp AS (SELECT cell, sum(n - k) / sum(n) AS d FROM (SELECT cell, ord, count(*) AS n, count(DISTINCT tok) AS k FROM nt WHERE kind = 'fin' GROUP BY ALL) GROUP BY cell)
SELECT c.cell, c.segments, c.final_segments, c.first_missing, coalesce(g, 1) AS gen_coverage, coalesce(f, 1) AS final_coverage, 100 * (coalesce(f, 1) - coalesce(g, 1)) AS gain, coalesce(d, 0) AS duplicate_rate
FROM (SELECT cell, count(*) AS segments, count(final) AS final_segments, count(*) FILTER (final IS NOT NULL AND first IS NULL) AS first_missing FROM sg GROUP BY cell) c LEFT JOIN sm USING (cell) LEFT JOIN dp USING (cell)""",
)
def exp_cell_metrics(spark, d):
    """Four cells of conversations, with their coverage before and after revision."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.first("text").alias("text"))
    answers = lambda name, by: rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - by).alias("turn"), F.col("text").alias(name))
    s = rows.where("role = 'user'").join(answers("first", 1), ["conv_id", "turn"], "left").join(answers("final", 3), ["conv_id", "turn"], "left")
    noted = lambda c, p: F.regexp_replace(c, p, "$1$2（$1）").alias(c)
    segments = s.select((F.col("conv_id") % 4).alias("cell"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("ord"), F.col("text").alias("source"), noted("first", _FIRST), noted("final", _FINAL))
    return E.cell_metrics(segments, L.lexicon_of(table(spark, d, "benchmark")))
