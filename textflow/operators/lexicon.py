"""Lexicons and form-aware joins.

Tokens are looked up in the table of all forms that the lexicon's words may have. It grows with
the lexicon alone, so the text is read once and the costly expansion into variants doesn't run over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..functions import text as T
from ..plans.layout import small_side


def lexicon_of(texts: DataFrame) -> DataFrame:
    """word, pending: the distinct tokens of ``text``; words of a length divisible by five are pending."""
    words = texts.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", (F.length("word") % 5 == 0).alias("pending"))


def resolve(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tok, base: each type's lexicon word (itself, its irregular singular, the base of an irregular verb or comparative, or the first variant that is one); null if none."""
    each = types.select("tok", F.posexplode(F.filter(F.concat(F.array("tok", T.singular(F.col("tok"))), forms.irregular_bases(F.col("tok")), T.variants(F.col("tok"))), lambda x: x.isNotNull())).alias("p", "word"))
    found = each.join(small_side(lexicon.select("word")), "word").groupBy("tok").agg(F.min_by("word", "p").alias("base"))
    return types.join(found, "tok", "left")


def pending_types(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Types that are forms (narrow set) of a pending word."""
    forms = types.select("tok", F.explode(T.variants(F.col("tok"), pending=True)).alias("word"))
    return forms.join(small_side(lexicon.where("pending").select("word")), "word", "left_semi").select("tok").distinct()


def known_forms(lexicon: DataFrame) -> DataFrame:
    """tok, base: ``resolve`` of every type that has a base, whatever the text: the rules are turned round, and what they give is resolved."""
    types = lexicon.select(F.explode(T.formed(F.col("word"))).alias("tok")).distinct()
    return small_side(resolve(types, lexicon).where("base IS NOT NULL"))


def numbered_forms(lexicon: DataFrame) -> DataFrame:
    """``known_forms`` with ``form``: 1, 2, ... among the forms of a base."""
    known = resolve(lexicon.select(F.explode(T.formed(F.col("word"))).alias("tok")).distinct(), lexicon).where("base IS NOT NULL")
    return small_side(known.withColumn("form", F.row_number().over(Window.partitionBy("base").orderBy("tok"))))


def pending_forms(lexicon: DataFrame) -> DataFrame:
    """tok: ``pending_types`` of all types."""
    types = lexicon.where("pending").select(F.explode(T.formed(F.col("word"))).alias("tok")).distinct()
    return small_side(pending_types(types, lexicon))


def mark(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with ``base`` and ``oov`` (no lexicon word, longer than a letter)."""
    return tokens.join(known_forms(lexicon), "tok", "left").withColumn("oov", F.col("base").isNull() & (F.length("tok") > 1))
