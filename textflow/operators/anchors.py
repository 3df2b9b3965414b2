"""Plot anchors: the phrases of a text that a revision must keep word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that a phrase worth quoting neither begins nor ends with
FUNCTION_WORDS = ("and", "or", "of", "the", "a", "an", "to", "in", "on", "at", "by", "from", "with", "for", "is", "are", "was", "were", "be", "been", "being", "that", "this", "it", "as", "but", "if")
QUOTED = '["“]([^"”\\n]{3,80})["”]'
TITLED = "[《【]([^》】\\n]{3,80})[》】]"
# word boundaries that know ASCII words only, as the patterns do
RUN = r"(?<!\w)[A-Za-z][A-Za-z'’-]*(?:\s+[A-Za-z'’-]+){1,6}(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
OPENING, CLOSING = "^[（(【《\"“']+", "[）)】》\"”'，。、；：]+$"


def _words(phrase: Column) -> Column:
    return F.filter(F.split(phrase, r"\s+"), lambda w: w != "")


def phrases(docs: DataFrame) -> DataFrame:
    """doc_id, anchor: quoted and titled pieces and runs of two to seven Latin words, in lower case, each once.

    Pieces end at slashes and bars; marks at their edges fall away. A piece has five characters
    and two words or more, and no function word at either end.
    """
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((QUOTED, 1), (TITLED, 1), (RUN, 0))))
    pieces = docs.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("x")).select("doc_id", F.explode(F.split("x", "[/／|]")).alias("x"))
    pieces = pieces.select("doc_id", F.lower(F.regexp_replace(F.regexp_replace(F.trim("x"), OPENING, ""), CLOSING, "")).alias("anchor")).withColumn("w", _words(F.col("anchor")))
    bare = lambda w: F.regexp_replace(w, "[^a-z']", "")
    ends = [bare(F.try_element_at("w", F.lit(i))) for i in (1, -1)]
    good = (F.length("anchor") >= 5) & F.col("anchor").rlike("[a-z]") & (F.size("w") >= 2) & ~ends[0].isin(*FUNCTION_WORDS) & ~ends[1].isin(*FUNCTION_WORDS)
    return pieces.where(good).select("doc_id", "anchor").distinct()


def maximal(anchors: DataFrame) -> DataFrame:
    """The anchors that no other anchor of their document contains.

    A contained phrase meets its container where its first two words meet: the end of the first
    word, and the second one (its first letter only, if it is the last word and may go on). So
    only anchors that share such a meeting are compared.
    """
    a = anchors.withColumn("w", _words(F.col("anchor"))).where(F.size("w") >= 2)
    last, first = F.right(F.element_at("w", 1), F.lit(1)), F.element_at("w", 2)
    asked = a.select("doc_id", "anchor", F.concat(last, F.when(F.size("w") > 2, F.concat(F.lit(" "), first)).otherwise(F.left(first, F.lit(1)))).alias("at"))
    places = F.sequence(F.lit(1), F.size("w") - 1)
    whole = F.transform(places, lambda i: F.concat(F.right(F.element_at("w", i), F.lit(1)), F.lit(" "), F.element_at("w", i + 1)))
    begun = F.transform(places, lambda i: F.concat(F.right(F.element_at("w", i), F.lit(1)), F.left(F.element_at("w", i + 1), F.lit(1))))
    holds = a.select("doc_id", F.col("anchor").alias("longer"), F.explode(F.array_distinct(F.concat(whole, begun))).alias("at"))
    inside = asked.join(holds, ["doc_id", "at"]).where((F.length("longer") > F.length("anchor")) & F.contains("longer", "anchor"))
    return anchors.join(inside.select("doc_id", "anchor").distinct(), ["doc_id", "anchor"], "left_anti")


def explicit(text: Column) -> Column:
    """The anchors that lines ``锚点: a, b`` name, single words too, in lower case and in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[-*]\s*)?锚点\s*[:：]\s*(.+)$"), F.lit(1))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, "[、,，;；|]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: p.rlike("[a-z]")))
