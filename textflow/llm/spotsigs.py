"""Document fingerprints: SpotSigs, in DataFrame expressions only.

A signature is a common-word anchor with the chain of the next content words behind it
(Theobald et al., 2008). A document's fingerprint is its set of hashed signatures. For
near-duplicate search sets are dealt into partitions by their size; sets are compared by
Jaccard only where size, a shared rare signature and position can still reach the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: common words of four languages; they anchor chains and never stand in one
ANCHORS = (
    "the a an of and to in is it that was for on are as with be at by this from or had not have but what which when there their will would can if "
    "der die das den dem des ein eine einer und zu mit ist nicht von auf für im sich auch als "
    "le la les un une et de du que qui en est dans pour au avec il pas ce sur plus ne "
    "el los las una y que del se por con para su al lo como más o sus"
).split()
CHAIN = 2  # content words in a chain
LOOK = 5  # anchors that a chain may run across before each of its words
RUN = 8  # words without an anchor after which a chain begins all the same
BUCKET_ROWS, BUCKETS = 1_024, 50_000  # rows in a range of ids, and ranges at most
SIMILARITY = 0.8


def _alternatives(words) -> str:
    """A pattern for any of ``words`` that shares their beginnings, so that most are ruled out by one character."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    parts = [c + (_alternatives(rest) if rest != {""} else "") for c, rest in sorted(heads.items())]
    one = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{one})?" if "" in words and parts else one if parts else ""


_SKIP = "(?: ++\u0001[^ ]*+){0,%d}+ ++" % LOOK
_CHAIN = "\u0001(?=([^ ]*+" + f"{_SKIP}[^ \u0001]++" + f"(?:{_SKIP}[^ \u0001]++)?+" * (CHAIN - 1) + "))"
_ACROSS = " ++(?:\u0001[^ ]*+ ++)*+"


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of the signatures. Null is empty.

    The start of each line counts as an anchor, and so does every eighth word of a run
    without one, so that texts with no common word have signatures too; only a text without letters or digits has none.
    """
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]++", " ")
    # a mark before each anchor
    marked = F.regexp_replace(words, r"(?<![^ \n])(?=" + _alternatives(set(ANCHORS)) + r"(?![^ \n]))", "\u0001")
    marked = F.regexp_replace(F.concat(F.lit("\n"), marked), r"\n[\n ]*+(?=[^ \u0001])", " \u0001 ")
    marked = F.regexp_replace(marked, "((?:(?<![^ ])[^ \u0001\n]++[ \n]++){%d})(?=[^ \u0001])" % RUN, "$1\u0001 ")
    chains = F.regexp_extract_all(F.translate(marked, "\n", " "), F.lit(_CHAIN), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.hash(F.regexp_replace(c, _ACROSS, ":")))))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def written(sig: Column) -> Column:
    """Signatures as one string: eight hexadecimal digits each."""
    unsigned = lambda h: h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)
    return F.array_join(F.transform(sig, lambda h: F.substring(F.hex(unsigned(h)), 2, 8)), ",")


def fingerprint(text: Column) -> Column:
    """The signature set as one string; equal texts have equal ones."""
    return written(signatures(text))


def likeness(x: Column, y: Column) -> Column:
    """Jaccard of two signature sets, 0 to 1; two empty ones are alike (1), one empty one is like no other (0)."""
    return F.when(x == y, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(_jaccard(x, y))


def _jaccard(x: Column, y: Column) -> Column:
    def ratio(both: Column) -> Column:
        return both / (F.size(x) + F.size(y) - both).cast("double")

    return let(F.size(F.array_intersect(x, y)).cast("double"), ratio)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b, jaccard) of representatives of different fingerprints with at least ``similarity``.

    Documents of one fingerprint are one representative (smallest id); empty fingerprints pair with nothing.
    Size partitions are powers of 1 / similarity, so a set meets its own and the next one only.
    Candidates share one of each set's rarest signatures, as many as its size lets differ.
    """
    sets = docs.select("doc_id", signatures(F.col("text")).alias("sig")).where(F.size("sig") > 0)
    sets = common.materialize(sets.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "spotsigs")
    each = sets.select("doc_id", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    # prefix filter: of n signatures by rarity, sets this alike share one among the first n - ceil(t n) + 1
    ranked = each.join(df, "s").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).where("df > 1")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity))).cast("int")
    left = prefix.select("s", part.alias("p"), F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("s", F.explode(F.array(part, part + 1)).alias("p"), F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("nb") <= F.col("na")) & (F.col("nb") >= F.lit(similarity) * F.col("na") - 1e-9) & ((F.col("na") > F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["s", "p"]).where(fits).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= similarity - 1e-9)


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving."""
    cuts, n = F.lit(bounds), len(bounds)

    def halve(at: Column, step: Column) -> Column:
        return F.when((at + step <= n) & (F.get(cuts, F.least(at + step, F.lit(n)) - 1) <= value), at + step).otherwise(at)

    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve) if n else F.lit(0)


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``sig``, ``next_text`` and ``next_sig``: the next document's, by descending doc_id (after the last: the first).

    Ids are dealt into ranges of about ``BUCKET_ROWS`` rows by approximate quantiles, so gaps
    between ids don't matter; a window looks within a range, and the first row of each range,
    one in a thousand, is handed to the range before it. Null ids come last, dealt into 256
    ranges by a hash of the text. Equal ids go by that hash, then by text.
    """
    n = docs.count()
    ranges = max(1, min(BUCKETS, n // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], F.lit(20 * ranges))).first()[0] if ranges > 1 else []
    h = F.xxhash64("text")
    bucket = F.coalesce(F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id"), sorted(set(cuts or [])))), -1 - F.shiftrightunsigned("h", 56).cast("int"))
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "h", "text")
    rows = docs.withColumn("h", h).withColumn("bucket", bucket)
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("sig", signatures(F.col("text")))
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sig", F.lead("sig").over(w))
    heads = rows.where("rn = 1").select("bucket", F.col("text").alias("head_text"))
    ring = Window.orderBy(F.desc("bucket"))
    ids = heads.select("bucket").withColumn("to", F.lead("bucket").over(ring))
    ids = ids.withColumn("to", F.coalesce("to", F.max("bucket").over(Window.partitionBy())))
    heads = ids.join(heads.withColumnRenamed("bucket", "to"), "to").select("bucket", "head_text")
    return rows.join(heads, "bucket")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Null and empty texts have the empty fingerprint; repeated rows stay, each with a next row; an empty table gives no row.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_or_empty().alias("text"))
    rows = with_next(docs)
    rows = rows.withColumn("inside", F.col("next_text").isNotNull()).withColumn("next_text", F.coalesce("next_text", "head_text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sig", signatures(F.col("edited")))
    rows = rows.withColumn("next_sig", F.when(F.col("inside"), F.col("next_sig")).otherwise(signatures(F.col("next_text"))))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


QUERIES = {"op3_spotsigs": op3_spotsigs}
ORACLES: dict[str, str] = {}
