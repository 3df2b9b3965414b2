"""Replay of a ledger of marks on the present texts: words, phrases and sentences are located anew.

Marks are kept by their wording, since places move whenever a text is edited. A word is found
by an equi-join with the tokens. A phrase is found by one word (the first one, or one that stands
inside, so that all of it is in the text; the one that fewest phrases share) and then compared as
a whole; a sentence by its first characters, joined for each length that occurs. No text is
compared with all anchors. Anchors are few beside the words, so they go to the words where their
number allows it, and the texts stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.layout import scratch, small_side

PREFIX = 24  # characters by which a sentence is known
#: types that ask for a word to go: where it is gone they are settled
SETTLED_WHEN_GONE = ("simpl", "oov", "hard", "cut", "paraphrase", "syntax", "long", "others")  # fixed values
PLACE = ("doc_id", "seg_idx", "sent_idx")


def sentence_rows(docs: DataFrame, *scope: str) -> DataFrame:
    """doc_id, the scope's columns, seg_idx, sent_idx, sent (lower case), and its words as they stand (``raw``) and as tokens (``tok``)."""
    segs = docs.select("doc_id", *scope, F.posexplode_outer(T.segments(F.col("text"))).alias("seg_idx", "body")).where("seg_idx IS NOT NULL")
    rows = segs.select("doc_id", *scope, (F.col("seg_idx") + 1).alias("seg_idx"), F.posexplode_outer(T.sentences(F.col("body"))).alias("sent_idx", "sent")).where("sent_idx IS NOT NULL")
    raw = F.regexp_extract_all(F.lower("sent"), F.lit("[a-z][a-z'-]*"), F.lit(0))
    rows = rows.withColumn("sent_idx", F.col("sent_idx") + 1).withColumn("sent", F.lower("sent")).withColumn("raw", raw)
    return rows.withColumn("tok", F.transform("raw", T.clean_token))


def word_rows(rows: DataFrame, *scope: str) -> DataFrame:
    """Scope, place, ``word_idx`` (from 1), and the word as it stands (``raw``) and as a token (``tok``)."""
    pair = F.posexplode(F.arrays_zip("raw", "tok")).alias("word_idx", "w")
    return rows.select(*scope, *PLACE, pair).select(*scope, *PLACE, (F.col("word_idx") + 1).alias("word_idx"), "w.raw", "w.tok")


def locate_words(rows: DataFrame, anchors: DataFrame, *scope: str) -> DataFrame:
    """Scope, anchor and place (with ``word_idx``, from 1) of every word that is the anchor as it stands or as a token."""
    words = word_rows(rows, *scope).select(*scope, *PLACE, "word_idx", F.explode(F.array_distinct(F.array("raw", "tok"))).alias("anchor"))
    return words.join(small_side(anchors.select(*scope, "anchor").where("anchor <> ''").distinct()), [*scope, "anchor"])


def locate_phrases(rows: DataFrame, anchors: DataFrame, *scope: str) -> DataFrame:
    """Scope, anchor and place of each of a phrase's first words in the sentences that hold the whole phrase."""
    words = F.regexp_extract_all("anchor", F.lit("[a-z][a-z'-]*"), F.lit(0))
    asked = anchors.select(*scope, "anchor").distinct().withColumn("words", words).where(F.size("words") > 0)
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))  # the last word may go on in the text
    keys = asked.select(*scope, "anchor", F.explode(F.array_distinct(F.concat(F.slice("words", 1, 1), inner))).alias("key"))
    shared = keys.groupBy(*scope, "key").agg(F.count(F.lit(1)).alias("n"))
    fewest = keys.join(shared, [*scope, "key"]).groupBy(*scope, "anchor").agg(F.min_by("key", F.struct("n", -F.length("key"), "key")).alias("key"))
    held = rows.select(*scope, *PLACE, "sent", F.explode(F.array_distinct(F.concat("raw", "tok"))).alias("key"))
    found = held.join(small_side(fewest), [*scope, "key"]).where(F.contains("sent", "anchor")).drop("key")
    found = found.withColumn("raw", F.regexp_extract_all("sent", F.lit("[a-z][a-z'-]*"), F.lit(0))).withColumn("tok", F.transform("raw", T.clean_token))
    first = F.regexp_extract("anchor", "[a-z][a-z'-]*", 0)
    at = F.filter(F.sequence(F.lit(1), F.size("raw")), lambda i: (F.element_at("raw", i) == first) | (F.element_at("tok", i) == first))
    return found.select(*scope, "anchor", *PLACE, F.explode(at).alias("word_idx"))


def locate_sentences(rows: DataFrame, anchors: DataFrame, *scope: str) -> DataFrame:
    """Scope, anchor and place (``word_idx`` 1) of the sentences that begin with the anchor's first characters."""
    asked = anchors.select(*scope, "anchor").where("anchor <> ''").distinct().withColumn("prefix", F.substring("anchor", 1, PREFIX)).withColumn("n", F.length("prefix"))
    lengths = F.broadcast(asked.select("n").distinct())  # PREFIX rows at most
    heads = rows.join(lengths, F.length("sent") >= F.col("n")).select(*scope, *PLACE, "n", F.expr("substring(sent, 1, n)").alias("prefix"))
    return heads.join(small_side(asked), [*scope, "n", "prefix"]).select(*scope, "anchor", *PLACE, F.lit(1).alias("word_idx"))


def live(events: DataFrame, *scope: str) -> DataFrame:
    """The last event of each (scope, level, anchor) by time, then id; none where it removes the mark."""
    order = F.struct("ts", "id")
    last = events.groupBy(*scope, "level", "anchor").agg(F.max_by(F.struct("id", "ts", "type", "action"), order).alias("x"))
    return last.select(*scope, "level", "anchor", "x.*").where("action <> 'remove'").drop("action")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: a row for each anchor, asked for several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spots(docs: DataFrame, events: DataFrame, *scope: str, levels: tuple[str, ...] = ("word", "phrase", "sent")) -> DataFrame:
    """Every place that each event's anchor has now: the event's columns and the place."""
    rows = sentence_rows(docs, *scope)
    of = {"word": locate_words, "phrase": locate_phrases, "sent": locate_sentences}
    found = [of[level](rows, events.where(F.col("level") == level), *scope).withColumn("level", F.lit(level)).select(*scope, "level", "anchor", *PLACE, "word_idx") for level in levels]
    return small_side(events).join(reduce(DataFrame.unionByName, found), [*scope, "level", "anchor"])


def _word_marks(docs: DataFrame, now: DataFrame, earlier: DataFrame, *scope: str) -> DataFrame:
    """The new marks of words. All that may stand at a place are its word and its token, so each place is settled where it is read."""
    live_ = now.where("level = 'word'").select(*scope, "anchor", F.struct("ts", "id", "anchor", "type").alias("mark"))
    types = earlier.where("level = 'word'").groupBy(*scope, "anchor").agg(F.collect_set("type").alias("types"))
    known = small_side(live_.join(types, [*scope, "anchor"], "full"))
    words = word_rows(sentence_rows(docs, *scope), *scope)
    for w in ("raw", "tok"):
        words = words.join(known.select(*scope, F.col("anchor").alias(w), F.col("mark").alias(f"{w}_mark"), F.col("types").alias(f"{w}_types")), [*scope, w], "left")
    words = words.where("raw_mark IS NOT NULL OR tok_mark IS NOT NULL")
    none = F.array().cast("array<string>")
    taken = F.concat(F.coalesce("raw_types", none), F.coalesce("tok_types", none))
    free = F.array_sort(F.filter(F.array("raw_mark", "tok_mark"), lambda m: m.isNotNull()))  # by ts, then id
    words = words.select(*PLACE, "word_idx", taken.alias("taken"), free.alias("free"))
    # two marks of one type: the earlier one
    first = F.filter("free", lambda m, i: ~F.array_contains("taken", m["type"]) & ((i == 0) | (m["type"] != F.element_at("free", 1)["type"])))
    return words.select(*PLACE, "word_idx", F.explode(first).alias("m")).select("m.id", "m.anchor", F.lit("word").alias("level"), "m.type", *PLACE, "word_idx")


def replay(docs: DataFrame, events: DataFrame, existing: DataFrame | None, *scope: str, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new marks, live events that have no place any more with a verdict).

    ``docs``: doc_id, text and the scope's columns. ``events``: id, ts, level (word, phrase,
    sent), anchor, type, action, and the scope. ``existing``: the marks that are there, as
    level, type and place (``word_idx`` 1 for sentences), or else ``earlier``: the marks whose
    places are taken, as scope, level, anchor and type. A place takes one mark of a level and
    type: an existing one, else that of the earliest event; so a second replay adds nothing.
    Anchors are compared in lower case and trimmed; events without an anchor have no place.
    """
    events = events.withColumn("anchor", F.lower(F.trim("anchor")))
    now = kept(live(events.where("anchor <> ''"), *scope), "live")
    key = ["level", "type", *PLACE, "word_idx"]
    levels = ("word", "phrase", "sent")
    if earlier is not None:
        levels, earlier = levels[1:], kept(earlier, "earlier")
        existing = spots(docs, earlier, *scope, levels=levels)
    fresh = spots(docs, now, *scope, levels=levels).join(existing.select(*key).distinct(), key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min_by(F.struct("id", "anchor"), F.struct("ts", "id")).alias("x"))
    marks = first.select("x.id", "x.anchor", *key)
    if earlier is not None:
        marks = marks.unionByName(_word_marks(docs, now, earlier, *scope))
    marks = marks.select(F.concat_ws(":", F.lit("cal"), "id", *PLACE, "word_idx").alias("mark_id"), "id", "anchor", *key)
    gone = now.join(spots(docs, now, *scope).select("id").distinct(), "id", "left_anti")
    settled = F.col("type").isin(*SETTLED_WHEN_GONE)
    return marks, gone.select(*scope, "id", "level", "anchor", "type", F.when(settled, "done").otherwise("check").alias("verdict"))


def effective(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The versions that still hold, with ``seq`` (their number over all rows of the document, from 1) and what other columns came.

    ``nodes``: doc, version, order (sortable), rolls_back (null: no rollback; '': the last
    version that holds; else the version to undo). A rollback voids the version it names and
    every later one; one that names a version that no longer holds, or never was, changes nothing.

    Only the rollbacks of a document are folded in order: they leave ranges of sequence numbers.
    The rows themselves meet these ranges in a window, so a long history is sorted, not collected.
    """
    rows = nodes.withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy("order", "version")).cast("long"))
    versions = rows.where("rolls_back IS NULL").drop("rolls_back")
    back = rows.where("rolls_back IS NOT NULL").select(doc, F.col("seq").alias("at"), F.col("rolls_back").alias("version"))
    # the newest earlier version of that name; 0 where there is none, null for the last that holds
    named = versions.select(doc, "version", "seq")
    earlier = F.max(F.when(F.col("seq") < F.col("at"), F.col("seq")))
    victim = back.where("version <> ''").join(named, [doc, "version"], "left").groupBy(doc, "at").agg(F.coalesce(earlier, F.lit(0)).alias("victim"))
    steps = back.where("version = ''").select(doc, "at", F.lit(None).cast("long").alias("victim")).unionByName(victim)
    ranges = steps.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "victim"))).alias("steps"))
    ranges = ranges.select(doc, F.explode(_ranges(F.col("steps"))).alias("x")).select(doc, F.col("x.a").alias("seq"), F.col("x.b").alias("until"), F.lit(True).alias("range"))
    marked = versions.unionByName(ranges, allowMissingColumns=True)
    before = Window.partitionBy(doc).orderBy("seq", F.col("range").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    plain = F.count("range").over(Window.partitionBy(doc)) == 0  # a document without rollbacks
    marked = marked.withColumn("upto", F.last("until", ignorenulls=True).over(before)).withColumn("plain", plain)
    return marked.where("range IS NULL AND (plain OR seq <= upto)").drop("range", "until", "upto", "plain", "order")


_RANGE = "array<struct<a:bigint,b:bigint>>"


def _ranges(steps: Column) -> Column:
    """What is left of 1, 2, ... after all steps, as ranges (the last one without an end); a step's own number is no version."""
    far = F.lit((1 << 62)).cast("long")
    span = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    start = F.array(span(F.lit(1), far)).cast(_RANGE)

    def step(held: Column, s: Column) -> Column:
        open_ = F.element_at(held, -1)
        # close the open range before the step; leave out an empty one
        closed = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.filter(F.array(span(open_["a"], s["at"] - 1)), lambda r: r["a"] <= r["b"]))
        victim = F.coalesce(s["victim"], F.try_element_at(F.transform(closed, lambda r: r["b"]), F.lit(-1)), F.lit(0))
        holds = F.exists(closed, lambda r: (r["a"] <= victim) & (victim <= r["b"]))
        before = F.filter(F.transform(closed, lambda r: span(r["a"], F.least(r["b"], victim - 1))), lambda r: r["a"] <= r["b"])
        return F.concat(F.when(holds, before).otherwise(closed), F.array(span(s["at"] + 1, far))).cast(_RANGE)

    return F.aggregate(steps, start, step)
