"""Queries over ledgers, queues, experiments, schedules and lineage.

``events`` is the decision ledger (user = teacher, event type = decision, ``props.k`` = item,
value = cost), ``orders`` and ``customer`` are runs and their registry, ``part`` a user table.
The texts run on Spark and on DuckDB; where the engines' dialects differ the second text is DuckDB's.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.layout import numbered, salted_collect, scratch, small_side
from .base import query, shared, table

_DUCK = (
    (r"get_json_object\((\w+\.)?props, '\$\.k'\)", r"json_extract_string(\1props, '$.k')"),
    (r"\bmax_by\((\w+), struct\(", r"arg_max(\1, ("),
    (r"\bmin_by\((\w+), struct\(", r"arg_min(\1, ("),
    (r"\bAS STRING\)", "AS VARCHAR)"),
    (r"\bto_date\(", "date("),
    (r"\bsha2\((.*?), 256\)", r"sha256(\1)"),
    (r"array_join\(array_sort\(collect_set\((\w+)\)\), ','\)", r"string_agg(DISTINCT \1, ',' ORDER BY \1)"),
    (r"array_join\(array_sort\(collect_list\((\w+)\)\), ','\)", r"string_agg(\1, ',' ORDER BY \1)"),
    (r"\btry_divide\((.*?), (.*?)\) AS", r"(\1) / nullif(\2, 0) AS"),
    (r"count_if\(", "countif("),
    (r"LEFT SEMI JOIN", "SEMI JOIN"),
    (r"LEFT ANTI JOIN", "ANTI JOIN"),
)


def _duck(sql: str) -> str:
    for a, b in _DUCK:
        sql = re.sub(a, b, sql)
    return sql


def both(name: str, sql: str, duck: str | None = None) -> None:
    shared(name, sql, duck or _duck(sql))


# decision events: item, teacher, kind, position
DEC = """dec AS (SELECT event_id, ts, user_id AS teacher, CAST(get_json_object(props, '$.k') AS BIGINT) AS item, value AS cost,
 CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'reject' WHEN 'signup' THEN 'false-positive' WHEN 'error' THEN 'undo' ELSE event_type END AS kind FROM @events)"""
LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS rn FROM dec WHERE kind <> 'undo') x WHERE rn = 1)"""
UNDO = """undo AS (SELECT u.event_id AS undo_id, u.item, u.teacher, max(d.event_id) AS undone FROM dec u JOIN dec d ON d.item = u.item AND d.teacher = u.teacher AND d.event_id < u.event_id AND d.kind <> 'undo' WHERE u.kind = 'undo' GROUP BY u.event_id, u.item, u.teacher)"""

both("led_lww_fold", f"WITH {DEC}, {LATEST} SELECT item, kind, teacher, ts FROM latest")
both("led_pending", f"WITH {DEC}, {LATEST}, {UNDO} SELECT l.item, l.event_id, l.kind FROM latest l LEFT ANTI JOIN undo ON l.event_id = undo.undone WHERE l.kind IN ('accept', 'edit')")
both("led_contested", f"WITH {DEC} SELECT item, count(DISTINCT kind) AS kinds, count(*) AS n FROM dec WHERE kind <> 'undo' GROUP BY item HAVING count(DISTINCT kind) >= 2")
both("led_decision_query", f"WITH {DEC} SELECT event_id, teacher, item, kind, ts FROM dec WHERE kind IN ('accept', 'reject') AND teacher % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 200")
both("led_decision_stats", f"WITH {DEC} SELECT item % 7 AS rule, kind, count(*) AS n, try_divide(count_if(kind = 'false-positive'), count(*)) AS fp_rate FROM dec GROUP BY item % 7, kind")
both("led_item_history", f"WITH {DEC}, {UNDO} SELECT d.item, d.event_id, row_number() OVER (PARTITION BY d.item ORDER BY d.ts DESC, d.event_id DESC) AS round, u.undo_id FROM dec d LEFT JOIN (SELECT undone, min(undo_id) AS undo_id FROM undo GROUP BY undone) u ON u.undone = d.event_id")
both("led_state_after_undos", f"WITH {DEC}, r AS (SELECT *, sum(CASE WHEN kind = 'undo' THEN 1 ELSE 0 END) OVER (PARTITION BY teacher ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS undos FROM dec), p AS (SELECT *, row_number() OVER (PARTITION BY teacher, item ORDER BY ts DESC, event_id DESC) AS rn FROM r WHERE undos <= 1 AND kind <> 'undo') SELECT teacher, item, kind FROM p WHERE rn = 1")
both("led_proposals", f"WITH {DEC} SELECT item, kind, count(*) AS support, max_by(cost, struct(ts, event_id)) AS last_value FROM dec WHERE kind IN ('edit', 'false-positive') GROUP BY item, kind HAVING count(*) >= 2", _duck(f"WITH {DEC} SELECT item, kind, count(*) AS support, arg_max(cost, (ts, event_id)) AS last_value FROM dec WHERE kind IN ('edit', 'false-positive') GROUP BY item, kind HAVING count(*) >= 2"))
both("led_candidates", f"WITH {DEC}, e AS (SELECT item, teacher, max(CASE WHEN kind = 'undo' THEN 1 ELSE 0 END) AS undone FROM dec GROUP BY item, teacher) SELECT item, count(*) AS evidence, sum(1 - undone) / count(*) AS confidence, CASE WHEN count(*) > 20 THEN 'book' WHEN count(*) >= 2 THEN 'chapter' ELSE 'sentence' END AS scope FROM e GROUP BY item")
both("led_reusable", f"WITH {DEC}, e AS (SELECT item, count(DISTINCT teacher) AS n FROM dec WHERE kind = 'accept' GROUP BY item), r AS (SELECT item, CASE WHEN n > 20 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END AS rank FROM e) SELECT item, rank FROM r WHERE rank >= 2")
both("led_roster", "SELECT coalesce(c.c_custkey, o.o_custkey) AS teacher, CASE WHEN o.o_custkey IS NULL THEN 'registered only' WHEN c.c_custkey IS NULL THEN 'runs only' ELSE 'both' END AS state, coalesce(o.runs, 0) AS runs FROM @customer c FULL OUTER JOIN (SELECT o_custkey, count(*) AS runs FROM @orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
both("led_chain_breaks", "WITH v AS (SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM @events) SELECT user_id, count(*) AS versions, count_if(before IS NOT NULL AND value < before) AS breaks, min(CASE WHEN value < before THEN event_id END) AS first_break FROM v GROUP BY user_id")

# metrics and experiments
both("agg_adoption_grouping_sets", f"WITH {DEC} SELECT item % 7 AS rule, to_date(ts) AS day, grouping(item % 7) AS g_rule, grouping(to_date(ts)) AS g_day, count_if(kind = 'accept') AS accepted, count_if(kind = 'reject') AS rejected, try_divide(count_if(kind = 'accept'), count_if(kind IN ('accept', 'reject'))) AS rate FROM dec GROUP BY GROUPING SETS ((item % 7), (to_date(ts)), ())")
both("agg_cost", f"WITH {DEC} SELECT item % 4 AS provider, sum((cost - cost / 4) / 1e6 + cost / 4 / 1e6 * 0.02 + cost / 1e6 * 4) AS cost, count(*) AS calls, count_if(kind = 'undo') AS errors FROM dec GROUP BY item % 4")
both("agg_band_rates", "WITH b AS (SELECT p_brand, p_type, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS band, p_retailprice AS rate FROM @part) SELECT band, count(*) AS items, avg(rate) AS mean_rate, avg(rate) - (SELECT avg(p_retailprice) FROM @part) AS gap FROM b GROUP BY band")
both("agg_book_report", "SELECT source, count(*) AS chapters, sum(n_chars) AS chars, count_if(n_chars < 200) AS attention FROM @documents GROUP BY source")
both("agg_ledger_summary", f"WITH {DEC} SELECT kind, count(*) AS n, count(DISTINCT teacher) AS teachers, max(ts) AS last_ts FROM dec GROUP BY kind")
both("agg_median", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 2) AS median FROM @orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS median FROM @orders GROUP BY o_orderpriority")
both("agg_debt", f"WITH {DEC} SELECT 'rework' AS what, count(*) AS n FROM dec WHERE kind = 'reject' UNION ALL SELECT 'quarantine', count(*) FROM @labels WHERE toxic = 1 UNION ALL SELECT 'source', count(*) FROM @documents WHERE n_chars < 50")
both("acc_segment_inversions", "SELECT a.conv_id, a.turn, length(a.text) AS easy, length(b.text) AS hard FROM @conversations a JOIN @conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE length(a.text) > length(b.text)")
both("exp_factor_contrast", f"WITH {DEC}, c AS (SELECT item % 2 AS f1, teacher % 2 AS f2, count_if(kind = 'accept') / count(*) AS cov FROM dec GROUP BY item % 2, teacher % 2) SELECT avg(CASE WHEN f1 = 1 THEN cov END) - avg(CASE WHEN f1 = 0 THEN cov END) AS d1, avg(CASE WHEN f2 = 1 THEN cov END) - avg(CASE WHEN f2 = 0 THEN cov END) AS d2 FROM c")
both("exp_truncation", "WITH t AS (SELECT conv_id, CASE WHEN length(text) > 40 THEN CASE WHEN text LIKE '%.' THEN 0 ELSE 1 END END AS cut FROM @conversations WHERE role = 'assistant') SELECT count(*) AS n, count(cut) AS known, try_divide(sum(cut), count(cut)) AS rate FROM t")
both("exp_trace", f"WITH {DEC} SELECT kind, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, count_if(item IS NULL) AS untraceable FROM dec GROUP BY kind")
both("exp_readiness", f"WITH {DEC}, u AS (SELECT item % 5 AS cell, count(DISTINCT teacher) AS teachers FROM dec GROUP BY item % 5) SELECT cell, teachers, CASE WHEN teachers = 0 THEN 'not run' WHEN teachers < 3 THEN 'gaps' ELSE 'ready' END AS state FROM u")
both("exp_metric_values", f"WITH {DEC} SELECT item, try_divide(count_if(kind = 'accept'), count_if(kind IN ('accept', 'reject'))) AS value, CASE WHEN count_if(kind IN ('accept', 'reject')) = 0 THEN 'no judged event' END AS why FROM dec GROUP BY item")
both("win_early_late", f"WITH {DEC}, r AS (SELECT *, row_number() OVER (PARTITION BY teacher ORDER BY ts, event_id) AS rn FROM dec), a AS (SELECT teacher, count(*) AS ops, try_divide(count_if(rn <= 10 AND kind = 'undo'), count_if(rn <= 10)) AS early, try_divide(count_if(rn > 10 AND kind = 'undo'), count_if(rn > 10)) AS late, count_if(rn > 10) AS late_ops FROM r GROUP BY teacher) SELECT teacher, ops, early, late, late_ops >= 3 AND late > 1.5 * early AND late > 0.1 AS fatigue FROM a")
both("win_first_success", f"WITH {DEC} SELECT teacher, min(ts) AS first_ts, min(CASE WHEN kind = 'accept' THEN ts END) AS first_success, count_if(kind = 'accept') AS successes, CASE WHEN count_if(kind = 'edit') > 0 THEN 'marker' WHEN count_if(kind = 'accept') > 0 THEN 'inferred' ELSE 'unknown' END AS state FROM dec GROUP BY teacher")

# queues
both("q_pending_facets", f"WITH {DEC}, {LATEST}, s AS (SELECT item, count(DISTINCT teacher) AS spread FROM dec GROUP BY item) SELECT l.item, l.kind = 'edit' AS star, s.spread >= 3 AS recur, s.spread = 1 AS single FROM latest l JOIN s ON s.item = l.item")
both("q_pending_merge", f"WITH {DEC}, u AS (SELECT item, 1 AS prio, kind FROM dec WHERE kind = 'edit' UNION ALL SELECT item, 2, kind FROM dec WHERE kind = 'accept' UNION ALL SELECT item, 3, kind FROM dec WHERE kind = 'reject') SELECT item, min(prio) AS prio, array_join(array_sort(collect_set(kind)), ',') AS reasons FROM u GROUP BY item")
both("q_pending_progress", f"WITH {DEC} SELECT item % 20 AS chapter, count(DISTINCT item) AS items, count(DISTINCT CASE WHEN kind = 'accept' THEN item END) AS settled FROM dec GROUP BY item % 20")
both("q_batch_preview", f"WITH {DEC} SELECT item, count(*) AS n, count(DISTINCT teacher) AS segments, count(DISTINCT to_date(ts)) AS chapters FROM dec GROUP BY item")
both("q_today", f"WITH {DEC}, d AS (SELECT max(to_date(ts)) AS day FROM dec) SELECT count_if(kind IN ('accept', 'edit')) AS done, count_if(kind = 'reject') AS failed, count_if(kind = 'undo') AS undone FROM dec JOIN d ON to_date(dec.ts) = d.day")
both("q_resume_drift", f"WITH {DEC}, c AS (SELECT teacher, max(CASE WHEN kind = 'edit' THEN ts END) AS paused FROM dec GROUP BY teacher) SELECT d.teacher, count(*) AS since FROM dec d JOIN c ON c.teacher = d.teacher AND d.ts > c.paused GROUP BY d.teacher")
both("q_review_ingest", f"WITH {DEC}, r AS (SELECT event_id, item, teacher, CASE WHEN item IS NULL THEN 'no item' WHEN cost IS NULL THEN 'no value' WHEN row_number() OVER (PARTITION BY item, teacher, kind ORDER BY ts, event_id) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM dec) SELECT verdict, count(*) AS n FROM r GROUP BY verdict")
both("q_rework_ledger", f"WITH {DEC} SELECT kind AS verdict, item % 3 AS tier, count(*) AS n FROM dec GROUP BY kind, item % 3")


@query("q_notes_unplaced", "SELECT b.item_id, count(d.doc_id) AS placed FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def q_notes_unplaced(spark, d):
    """How many documents hold each note's whole text. Candidates hold its rarest inner run of three words; the text itself decides."""
    notes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("note"))
    grams = lambda text: T.shingles(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    words = F.filter(F.split("note", r"\s+"), lambda w: w != "")
    inner = T.shingles(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))  # the first and the last word may go on in a document
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    held = docs.select("doc_id", F.explode(F.transform(grams(F.col("text")), lambda g: F.xxhash64(g))).alias("gram"))
    asked = notes.select("item_id", "note", F.explode(F.transform(inner, lambda g: F.xxhash64(g))).alias("gram"))
    known = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    often = known.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(often, "gram", "left").groupBy("item_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = known.join(rare, "gram").select("item_id", "doc_id").distinct()
    short = notes.where(F.size(inner) <= 0)  # too short for a run: compared with every document, a few words each
    pairs = found.join(notes, "item_id").join(docs, "doc_id").where(F.contains("text", "note")).groupBy("item_id").agg(F.count("doc_id").alias("n"))
    few = short.join(docs, F.contains("text", "note")).groupBy("item_id").agg(F.count("doc_id").alias("n"))
    return notes.join(pairs.unionByName(few), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("placed"))


both("run_resume_plan", "SELECT o.o_orderkey FROM @orders o LEFT ANTI JOIN @lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F'")

# sets, tables, validation
both("set_targets_merge", f"WITH {DEC}, g AS (SELECT count(DISTINCT item % 3) AS n FROM dec), w AS (SELECT teacher, count(DISTINCT item % 3) AS m, count(*) AS picks FROM dec WHERE kind = 'accept' GROUP BY teacher) SELECT teacher, picks FROM w JOIN g ON w.m = g.n ORDER BY picks DESC, teacher LIMIT 12")
both("set_vocab_dedupe", "SELECT lower(p_type) AS word, min(p_size) AS shortest, max(p_size) AS longest, array_join(array_sort(collect_set(p_brand)), ',') AS brands FROM @part GROUP BY lower(p_type)")
both("set_dict_merge", "WITH u AS (SELECT p_name AS word, p_brand AS gloss, 0 AS prio FROM @part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, p_type, 1 FROM @part WHERE p_partkey % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY prio, gloss) AS rn, count(*) OVER (PARTITION BY word) AS n FROM u) SELECT word, gloss, n > 1 AS conflict FROM r WHERE rn = 1")
both("set_new_violations", "SELECT p_brand AS rule FROM @part WHERE p_size > 25 EXCEPT ALL SELECT p_brand FROM @part WHERE p_size > 40")
both("chk_table_rules", "SELECT p_partkey, CASE WHEN p_name IS NULL THEN 'required' WHEN count(*) OVER (PARTITION BY p_partkey) > 1 THEN 'unique key' WHEN p_size < 1 OR p_size > 45 THEN 'range' WHEN NOT (p_brand LIKE 'Brand#%') THEN 'enum' ELSE 'ok' END AS verdict FROM @part")
# the missing runs of each source's document numbers, counted in ranges of 1,000 so that no source is one task
shared(
    "chk_sequence_gaps",
    """WITH u AS (SELECT DISTINCT source, doc_id, doc_id DIV 1000 AS part FROM @documents WHERE doc_id IS NOT NULL),
inside AS (SELECT source, lag(doc_id) OVER (PARTITION BY source, part ORDER BY doc_id) AS lo, doc_id AS hi FROM u),
edges AS (SELECT source, part, min(doc_id) AS first, max(doc_id) AS last FROM u GROUP BY source, part),
between AS (SELECT source, lag(last) OVER (PARTITION BY source ORDER BY part) AS lo, first AS hi FROM edges)
SELECT source, lo + 1 AS missing_from, hi - 1 AS missing_to, hi - lo - 1 AS missing FROM (SELECT * FROM inside WHERE lo IS NOT NULL UNION ALL SELECT * FROM between WHERE lo IS NOT NULL) g WHERE hi - lo > 1""",
    """WITH u AS (SELECT DISTINCT source, doc_id FROM documents WHERE doc_id IS NOT NULL), g AS (SELECT source, doc_id AS hi, max(doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM u)
SELECT source, lo + 1 AS missing_from, hi - 1 AS missing_to, hi - lo - 1 AS missing FROM g WHERE hi - lo > 1""",
)
both("tbl_upsert", "SELECT p_partkey, p_size + 1 AS p_size FROM @part WHERE p_partkey % 10 = 0 UNION ALL SELECT p.p_partkey, p.p_size FROM @part p LEFT ANTI JOIN (SELECT p_partkey FROM @part WHERE p_partkey % 10 = 0) n ON n.p_partkey = p.p_partkey")
both("eval_report_diff", "SELECT coalesce(a.l_orderkey, b.o_orderkey) AS k, CASE WHEN a.l_orderkey IS NULL THEN 'only right' WHEN b.o_orderkey IS NULL THEN 'only left' WHEN abs(a.total - b.o_totalprice) < 1 THEN 'same' ELSE 'changed' END AS verdict FROM (SELECT l_orderkey, sum(l_extendedprice) AS total FROM @lineitem GROUP BY l_orderkey) a FULL OUTER JOIN @orders b ON a.l_orderkey = b.o_orderkey")
both("gr_descendants", "WITH RECURSIVE e(parent, child) AS (SELECT concat('r', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)) FROM @nation UNION ALL SELECT concat('n', CAST(c_nationkey AS STRING)), concat('c', CAST(c_custkey AS STRING)) FROM @customer), d(root, node, depth) AS (SELECT concat('r', CAST(r_regionkey AS STRING)), concat('r', CAST(r_regionkey AS STRING)), 0 FROM @region UNION ALL SELECT d.root, e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node WHERE d.depth < 4) SELECT root, depth, count(*) AS n FROM d GROUP BY root, depth")


@query(
    "sim_fuzzy_names",
    """WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, levenshtein(a.s_name, b.s_name) AS dist, CASE WHEN least(length(a.s_name), length(b.s_name)) <= 4 THEN 1 ELSE 2 END AS most FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey)
SELECT a, b, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS place FROM p WHERE dist <= most QUALIFY place <= 3""",
)
def sim_fuzzy_names(spark, d):
    """The three nearest other names within two edits (one, where a name has at most four characters).

    Names meet where they are equal after as many deletions each as they are edits apart, first
    those one edit apart; two edits are looked for only where fewer than four ids are nearer, since
    a row drops itself and keeps three. Equal names are put together, and of each name its four
    smallest ids are enough; so a name that many rows bear, or has many neighbours, makes few pairs.
    What is left after deletions is known by its hash. Spark takes the table of it for as small as the
    names it comes from, so it is sorted unless its rows were counted: no broadcast of it fills the driver.
    """
    names = table(spark, d, "supplier").where("s_name IS NOT NULL").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    few = salted_collect(names, ["name"], [F.col("id")], 4).select("name", F.col("id").alias("b"))
    without_one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    once = F.when(F.col("name") == "", F.array(F.lit(""))).otherwise(F.array_distinct(without_one(F.col("name"))))
    twice = F.flatten(F.transform("once", lambda w: hashes(F.when(w == "", F.array(w)).otherwise(without_one(w)))))

    def near(asked, edits):
        """name, dist, b: the ids of the other names that are just so many edits away."""
        held = [F.array(F.xxhash64("name")), hashes("once")] + [twice] * (edits > 1)
        keys = lambda some: some.withColumn("once", once).select("name", F.explode(F.array_distinct(F.concat(*held))).alias("key"))
        met = small_side(keys(asked)).join(keys(distinct).withColumnRenamed("name", "other").hint("merge"), "key").where("name <> other")
        close = met.where(F.levenshtein("name", "other", edits) == edits)
        if edits > 1:
            close = close.where(F.least(F.length("name"), F.length("other")) > 4)
        return close.select("name", "other").join(few.withColumnRenamed("name", "other").hint("merge"), "other").distinct().select("name", F.lit(edits).alias("dist"), "b")

    distinct = names.select("name").distinct()
    found = salted_collect(few.select("name", F.lit(0).alias("dist"), "b").unionByName(near(distinct, 1)), ["name"], [F.col("dist"), F.col("b")], 4).drop("rank")
    path = scratch(spark, "fuzzy-names")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    short = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n < 4").select("name")
    best = salted_collect(found.unionByName(near(short, 2)), ["name"], [F.col("dist"), F.col("b")], 4).drop("rank")
    place = F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))
    pairs = names.withColumnRenamed("id", "a").hint("merge").join(best, "name").where("a <> b")
    return pairs.select("a", "b", "dist", place.alias("place")).where("place <= 3")


# lineage
both("lin_drift_full_outer", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS drift FROM (SELECT l_partkey AS k, count(*) AS n FROM @lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) a FULL OUTER JOIN (SELECT l_partkey AS k, count(*) AS n FROM @lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) b ON a.k = b.k")
both("lin_provenance", f"WITH {DEC} SELECT d.doc_id, sha2(d.text, 256) AS hash, count(dec.event_id) AS decisions, count(dec.event_id) > 0 AS found FROM @documents d LEFT JOIN dec ON dec.item = d.doc_id GROUP BY d.doc_id, d.text")
# runs are orders, their artifacts lines: the part is the identity, part and supplier the path; an identity twice in a run falls back to its path
both(
    "lin_collisions",
    """WITH k AS (SELECT l_orderkey AS run, concat(CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS path, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1 THEN CAST(l_partkey AS STRING) ELSE concat('path:', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) END AS id FROM @lineitem),
p AS (SELECT id, path, count(DISTINCT run) AS runs FROM k GROUP BY id, path),
g AS (SELECT id, count(DISTINCT run) AS runs FROM k GROUP BY id HAVING count(DISTINCT run) >= 2),
r AS (SELECT g.id, g.runs, count(*) AS paths, count_if(p.runs > 1) AS overwritten FROM g JOIN p ON p.id = g.id GROUP BY g.id, g.runs),
rest AS (SELECT path, count(DISTINCT run) AS runs FROM k GROUP BY path HAVING count(DISTINCT run) >= 2),
told AS (SELECT DISTINCT p.path FROM p JOIN g ON g.id = p.id WHERE p.runs > 1)
SELECT id, CASE WHEN overwritten > 0 THEN 'overwrite' ELSE 'fork' END AS collision, runs, paths, overwritten FROM r
UNION ALL SELECT concat('path:', rest.path), 'overwrite', rest.runs, 1, 1 FROM rest LEFT ANTI JOIN told ON told.path = rest.path""",
)
both("lin_publish_filter", "SELECT doc_id, CASE WHEN text LIKE '%@%.%' THEN 'mail' WHEN length(text) < 20 THEN 'empty' END AS excluded FROM @documents")
both("lin_lexicon_snapshot", "SELECT p_brand AS source, count(*) AS words, sha2(array_join(array_sort(collect_list(p_name)), ','), 256) AS version FROM @part GROUP BY p_brand")
both("lin_lexicon_decision", "WITH h AS (SELECT doc_id, sha2(text, 256) AS h FROM @documents) SELECT l.doc_id, CASE WHEN h.h IS NULL THEN 'live' WHEN substr(h.h, 1, 1) < '8' THEN 'store' ELSE 'reject' END AS decision FROM @labels l LEFT JOIN h ON h.doc_id = l.doc_id")
both("ver_pair_fidelity", "WITH p AS (SELECT a.label AS pair, aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v) AS dot FROM @embeddings a JOIN @embeddings b ON b.vec_id = a.vec_id + 1) SELECT pair, round(avg(dot), 5) AS mean, round(min(dot), 5) AS low, round(percentile(dot, 0.5), 5) AS median FROM p GROUP BY pair", "WITH p AS (SELECT a.label AS pair, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot FROM @embeddings a JOIN @embeddings b ON b.vec_id = a.vec_id + 1) SELECT pair, round(avg(dot), 5) AS mean, round(min(dot), 5) AS low, round(quantile_cont(dot, 0.5), 5) AS median FROM p GROUP BY pair")
both("ver_segment_cosine", "SELECT a.vec_id AS base, b.vec_id AS cur, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v), 5) AS dot FROM @embeddings a JOIN @embeddings b ON b.label = a.label AND b.vec_id = a.vec_id + 2", "SELECT a.vec_id AS base, b.vec_id AS cur, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM @embeddings a JOIN @embeddings b ON b.label = a.label AND b.vec_id = a.vec_id + 2")

# schedule: units are parts (brand = book, size = unit)
both("voc_due_plan", "WITH h AS (SELECT user_id AS word, count(*) AS hits FROM @events GROUP BY user_id), t(hits, days) AS (VALUES (1, 1), (2, 3), (3, 7), (4, 14), (5, 30)) SELECT h.word, h.hits, t.days, CAST(ceil(t.days / 3.0) AS BIGINT) AS pieces FROM h JOIN t ON t.hits = least(h.hits, 5)")


# --- numbered rows, without a window over all of them


@query("agg_systematic_sample", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS rn FROM part) WHERE rn % 25 = 1")
def agg_systematic_sample(spark, d):
    """Every 25th part by name."""
    return numbered(table(spark, d, "part").select("p_partkey", "p_name"), "rn", F.col("p_name"), F.col("p_partkey")).where("rn % 25 = 1").drop("rn")


@query("q_pending_sorted", _duck(f"WITH {DEC}, s AS (SELECT item, count(DISTINCT teacher) AS spread, count(*) AS n FROM dec GROUP BY item) SELECT item, spread, n, row_number() OVER (ORDER BY spread DESC, n DESC, item) AS place FROM s").replace("@", ""))
def q_pending_sorted(spark, d):
    """Items by how many teachers decided on them, then by decisions."""
    item = F.get_json_object("props", "$.k").cast("long").alias("item")
    spread = table(spark, d, "events").select(item, "user_id").groupBy("item").agg(F.countDistinct("user_id").alias("spread"), F.count(F.lit(1)).alias("n"))
    return numbered(spread, "place", F.desc("spread"), F.desc("n"), F.col("item"))


_DUE = "h AS (SELECT user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS word, count(*) AS hits, max(ts) AS seen FROM events GROUP BY ALL), t(hits, days) AS (VALUES (1, 1), (2, 3), (3, 7), (4, 14), (5, 30))"


@query("voc_weekly_due", f"WITH {_DUE} SELECT h.word, t.days, CAST(seen AS DATE) + t.days AS due, row_number() OVER (ORDER BY t.days, h.word) AS place FROM h JOIN t ON t.hits = least(h.hits, 5) WHERE t.days <= 7")
def voc_weekly_due(spark, d):
    """Words (of a learner and an item) that fall due within a week, soonest first, with the day."""
    word = (F.col("user_id") * 1000 + F.get_json_object("props", "$.k").cast("long")).alias("word")
    hits = table(spark, d, "events").select(word, "ts").groupBy("word").agg(F.least(F.count(F.lit(1)), F.lit(5)).cast("int").alias("hits"), F.max("ts").alias("seen"))
    days = F.element_at(F.array(*map(F.lit, (1, 3, 7, 14, 30))), F.col("hits"))
    due = hits.withColumn("days", days).where("days <= 7").select("word", "days", F.date_add(F.to_date("seen"), F.col("days")).alias("due"))
    return numbered(due, "place", F.col("days"), F.col("word"))
