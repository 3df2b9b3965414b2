"""Word-form families and profiles, numerals of chapters, and the SQL table function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import forms as M
from ..functions import sql
from ..operators import structure as S
from ..plans.layout import scratch
from .base import query, table
from .text_queries import _docs, _tok
from .text_sql import _BASES, SENT, TOK


@query("txt_sentences_sql", f"WITH {SENT} SELECT doc_id, seg_idx, sent_idx, sent FROM sent")
def txt_sentences_sql(spark, d):
    """All sentences by the table function ``text_sentences``, as a SQL user calls it."""
    sql.register(spark)
    S.segments(_docs(spark, d)).createOrReplaceTempView("tf_segments")
    return spark.sql("SELECT g.doc_id, g.seg_idx, s.idx AS sent_idx, s.sent FROM tf_segments g, LATERAL text_sentences(g.body) s")


def _rules(name: str) -> str:
    rules = [f"CASE WHEN regexp_matches(tok, '{end}') AND length(tok) >= {least} THEN left(tok, greatest(length(tok) - {cut}, 0)) || '{add}' END" for end, cut, add, least in M.PROFILES[name]]
    if name == "acceptance":  # no look-around here
        rules = [r.replace("(?<!i)er$", "(^|[^i])er$") for r in rules]
    if name == "adapt":  # nor back references: doubled letters by comparing them
        rules = [r.replace("regexp_matches(tok, '(.)\\1ing$')", "tok LIKE '%ing' AND length(tok) > 4 AND tok[-5] = tok[-4]").replace("regexp_matches(tok, '(.)\\1ed$')", "tok LIKE '%ed' AND length(tok) > 3 AND tok[-4] = tok[-3]") for r in rules]
    irregular = "CASE tok " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in sorted(_BASES.items())) + " ELSE []::VARCHAR[] END" if name == "adapt" else "[]::VARCHAR[]"
    return f"list_concat([tok], {irregular}, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL))"


@query(
    "fn_variants_profiles",
    f"WITH {TOK}, ty AS (SELECT DISTINCT tok FROM tok) "
    + " UNION ALL ".join(f"SELECT tok, '{name}' AS profile, array_to_string(list_sort(list_distinct({_rules(name)})), ' ') AS forms FROM ty" for name in M.PROFILES)
    + """ UNION ALL SELECT tok, 'injected', array_to_string([tok, tok || 's', tok || 'es', tok || 'ed', tok || 'ing', regexp_replace(tok, '([^aeiou])e$', '\\1') || 'ing', tok || right(tok, 1) || 'ing', tok || right(tok, 1) || 'ed'], ' ') FROM ty""",
)
def fn_variants_profiles(spark, d):
    """Every type of the corpus with its forms by each profile."""
    path = scratch(spark, "types")  # written, so that the tokens are worked out once for all profiles
    _tok(spark, d).select("tok").distinct().write.parquet(path)
    types = spark.read.parquet(path)

    tok = F.col("tok")
    forms = {name: F.array_join(F.array_sort(M.profile(tok, name)), " ") for name in M.PROFILES} | {"injected": F.array_join(M.injected(tok), " ")}
    return reduce(DataFrame.unionByName, (types.select("tok", F.lit(name).alias("profile"), f.alias("forms")) for name, f in forms.items()))


@query(
    "fn_chapter_name",
    """WITH p AS (SELECT page_id, (1 + page_id * 37 % 9999)::INT AS n FROM pages), d AS (SELECT *, n // 1000 AS q, n // 100 % 10 AS h, n // 10 % 10 AS t, n % 10 AS o, '零一二三四五六七八九' AS s FROM p),
x AS (SELECT *, CASE WHEN q > 0 THEN s[q + 1] || '千' ELSE '' END || CASE WHEN h > 0 THEN s[h + 1] || '百' WHEN q > 0 THEN '零' ELSE '' END || CASE WHEN t > 0 THEN s[t + 1] || '十' WHEN q + h > 0 THEN '零' ELSE '' END || CASE WHEN o > 0 THEN s[o + 1] ELSE '' END AS x FROM d)
SELECT page_id, '第' || regexp_replace(regexp_replace(regexp_replace(x, '零+', '零', 'g'), '零$', ''), '^一十', '十') || '章' AS name, n AS chapter FROM x""",
)
def fn_chapter_name(spark, d):
    """A chapter name in numerals for each page's number, and the number read back from the name."""
    n = (1 + F.col("page_id") * 37 % 9999).cast("int")
    named = table(spark, d, "pages").select("page_id", F.concat(F.lit("第"), M.chinese_name(n), F.lit("章")).alias("name"))
    return named.withColumn("chapter", M.chapter_number(F.col("name")))
