"""Marks replayed on located places, and versions with rollbacks that name their victim.

``events`` is the ledger. An event's anchor is a word, three words running, or the beginning of
a ``benchmark`` text (by user and item); its scope is a book, which is a ``source`` of documents.
For versions, ``error`` events roll back: every third one the last version, the others the one
that stands some places before it in their user's history, which may not hold any more or not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import replay as R
from .base import query, table
from .text_queries import _docs
from .text_sql import SENT, TOKENS

_EVENTS = rf"""item AS (SELECT item_id, text, {TOKENS.format('text')} AS toks, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM benchmark),
raw AS (SELECT event_id AS id, ts, 'src' || (user_id % 20) AS source, user_id + CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) % (SELECT count(*) FROM benchmark) AS item_id, user_id % 3 AS lv, event_type FROM events),
ev AS (SELECT id, ts, source, CASE lv WHEN 0 THEN 'word' WHEN 1 THEN 'phrase' ELSE 'sent' END AS level,
  lower(trim(CASE lv WHEN 0 THEN toks[1 + n % len(toks)] WHEN 1 THEN array_to_string(ws[1 + n % greatest(1, len(ws) - 2):3 + n % greatest(1, len(ws) - 2)], ' ') ELSE text END)) AS anchor,
  CASE event_type WHEN 'click' THEN 'simpl' WHEN 'purchase' THEN 'annotate' WHEN 'view' THEN 'oov' ELSE 'keep' END AS type, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action
  FROM raw JOIN item USING (item_id))"""


def ledger(spark, d) -> DataFrame:
    """id, ts, source, level, anchor, type, action."""
    bench = table(spark, d, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = bench.select("item_id", "text", T.tokens(F.col("text")).alias("toks"), words.alias("ws"))
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").crossJoin(bench.agg(F.count(F.lit(1)).alias("items"))).withColumn("item_id", k % F.col("items")).withColumn("n", F.col("user_id") + k).join(items, "item_id")
    at = 1 + F.col("n") % F.greatest(F.lit(1), F.size("ws") - 2)
    lv = F.col("user_id") % 3
    anchor = F.when(lv == 0, F.try_element_at("toks", (1 + F.col("n") % F.size("toks")).cast("int"))).when(lv == 1, F.array_join(F.slice("ws", at.cast("int"), F.lit(3)), " ")).otherwise(F.col("text"))
    kind = F.when(F.col("event_type") == "click", "simpl").when(F.col("event_type") == "purchase", "annotate").when(F.col("event_type") == "view", "oov").otherwise("keep")
    return rows.select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"),
        F.when(lv == 0, "word").when(lv == 1, "phrase").otherwise("sent").alias("level"),
        F.lower(F.trim(anchor)).alias("anchor"), kind.alias("type"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
    )


_PLACES = rf"""{SENT}, srow AS (SELECT s.doc_id, d.source, seg_idx, sent_idx, lower(sent) AS sent, regexp_extract_all(lower(sent), '[a-z][a-z''-]*') AS raw, {TOKENS.format('sent')} AS tok FROM sent s JOIN documents d ON d.doc_id = s.doc_id),
wd AS (SELECT doc_id, source, seg_idx, sent_idx, (i + 1)::INT AS word_idx, raw[i + 1] AS raw, tok[i + 1] AS tok FROM srow, unnest(range(len(raw))) AS t(i)),
{_EVENTS},
anchors AS (SELECT DISTINCT source, level, anchor FROM ev WHERE anchor <> ''),
spot AS (
  SELECT a.source, a.level, a.anchor, doc_id, seg_idx, sent_idx, word_idx FROM anchors a JOIN wd ON a.source = wd.source AND a.anchor = wd.raw WHERE level = 'word'
  UNION SELECT a.source, a.level, a.anchor, doc_id, seg_idx, sent_idx, word_idx FROM anchors a JOIN wd ON a.source = wd.source AND a.anchor = wd.tok WHERE level = 'word'
  UNION SELECT a.source, a.level, a.anchor, s.doc_id, s.seg_idx, s.sent_idx, word_idx FROM anchors a JOIN srow s ON a.source = s.source AND contains(s.sent, a.anchor)
    JOIN wd ON wd.doc_id = s.doc_id AND wd.seg_idx = s.seg_idx AND wd.sent_idx = s.sent_idx AND (wd.raw = regexp_extract(a.anchor, '[a-z][a-z''-]*') OR wd.tok = regexp_extract(a.anchor, '[a-z][a-z''-]*')) WHERE level = 'phrase'
  UNION SELECT a.source, a.level, a.anchor, doc_id, seg_idx, sent_idx, 1 FROM anchors a JOIN srow s ON a.source = s.source AND starts_with(s.sent, left(a.anchor, 24)) WHERE level = 'sent'),
latest AS (SELECT * FROM ev WHERE anchor <> '' QUALIFY row_number() OVER (PARTITION BY source, level, anchor ORDER BY ts DESC, id DESC) = 1),
live AS (SELECT * FROM latest WHERE action = 'add'),
half AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events),
existing AS (SELECT DISTINCT e.level, e.type, doc_id, seg_idx, sent_idx, word_idx FROM ev e JOIN spot USING (source, level, anchor) JOIN half ON e.ts < half.t WHERE action = 'add')"""


@query("txt_locate_spots", f"WITH {_PLACES} SELECT source, level, anchor, doc_id, seg_idx, sent_idx, word_idx FROM spot")
def txt_locate_spots(spark, d):
    """Every place of every anchor of the ledger, words, phrases and sentence beginnings, in the documents of its book."""
    anchors = ledger(spark, d).where("anchor <> ''").select("source", "level", "anchor").distinct()
    return R.spots(_docs(spark, d), R.kept(anchors, "anchors"), "source")


def _replayed(spark, d):
    events, docs = ledger(spark, d), _docs(spark, d)
    half = table(spark, d, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half"))
    before = events.crossJoin(half).where((F.col("ts") < F.col("half")) & (F.col("action") == "add")).drop("half")
    return R.replay(docs, events, None, "source", earlier=before.where("anchor <> ''").select("source", "level", "anchor", "type").distinct())


@query(
    "led_replay",
    f"""WITH {_PLACES}, fresh AS (SELECT l.id, l.ts, l.anchor, l.level, l.type, doc_id, seg_idx, sent_idx, word_idx FROM live l JOIN spot USING (source, level, anchor)
  ANTI JOIN existing x USING (level, type, doc_id, seg_idx, sent_idx, word_idx))
SELECT 'cal:' || id || ':' || doc_id || ':' || seg_idx || ':' || sent_idx || ':' || word_idx AS mark_id, id, anchor, level, type, doc_id, seg_idx, sent_idx, word_idx FROM fresh
QUALIFY row_number() OVER (PARTITION BY level, type, doc_id, seg_idx, sent_idx, word_idx ORDER BY ts, id) = 1""",
)
def led_replay(spark, d):
    """Marks of the ledger where their words stand now, but for those that the first half of the ledger has set already."""
    return _replayed(spark, d)[0]


@query(
    "led_replay_unmatched",
    f"""WITH {_PLACES} SELECT source, id, level, anchor, type, CASE WHEN type IN ({', '.join(f"'{t}'" for t in R.SETTLED_WHEN_GONE)}) THEN 'done' ELSE 'check' END AS verdict
FROM live l ANTI JOIN spot USING (source, level, anchor)""",
)
def led_replay_unmatched(spark, d):
    """Live marks without a place: settled if the word was to go, else to be looked at."""
    return _replayed(spark, d)[1]


@query(
    "led_effective_versions",
    """WITH v AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
-- a push is [seq]; a rollback [-1, seq of its victim, or 0 for the last one]; history in order
l AS (SELECT user_id, list_reduce(list_prepend([]::BIGINT[], list(CASE WHEN event_type <> 'error' THEN [seq] WHEN k % 3 = 0 THEN [-1, 0] ELSE [-1, seq - 1 - k % 11] END ORDER BY seq)),
  lambda acc, x: CASE WHEN x[1] <> -1 THEN list_concat(acc, x) WHEN x[2] = 0 AND len(x) = 2 AND x[1] = -1 THEN acc[:-2] WHEN list_contains(acc, x[2]) THEN acc[:list_position(acc, x[2]) - 1] ELSE acc END) AS held FROM v GROUP BY user_id)
SELECT v.user_id, v.event_id, v.seq FROM v JOIN (SELECT user_id, unnest(held) AS seq FROM l) h ON h.user_id = v.user_id AND h.seq = v.seq""",
)
def led_effective_versions(spark, d):
    """What holds of each user's history after all rollbacks. Rollbacks with no place left before them (0) undo the last one."""
    k, seq = F.get_json_object("props", "$.k").cast("long"), F.col("seq")
    numbered = table(spark, d, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    target = seq - 1 - k % 11
    back = F.when(F.col("event_type") == "error", F.when((k % 3 == 0) | (target == 0), F.lit("")).otherwise(target.cast("string")))
    nodes = numbered.select("user_id", F.when(F.col("event_type") == "error", F.concat(F.lit("r"), seq)).otherwise(seq.cast("string")).alias("version"), seq.alias("order"), back.alias("rolls_back"), "event_id")
    return R.effective(nodes, "user_id").select("user_id", "event_id", "seq")
