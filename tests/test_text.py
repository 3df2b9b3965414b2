"""Rule traps of the text functions, on sentences of our own."""

import pytest
from pyspark.sql import functions as F

from textflow.functions import text as T
from textflow.operators import annot


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("The gate was opened by the guard.", 1),
        ("He was interested in maps.", 0),
        ("The bread was eaten.", 1),
        ("A song, played by the band, ended.", 1),
        ("They walked home.", 0),
    ],
)
def test_passive(spark, text, n):
    assert one(spark, text, T.passives) == n


@pytest.mark.parametrize(("text", "n"), [("the man who sings", 1), ("the cat that purrs", 1), ("He knew that the dog runs", 0), ("a night that day ended", 0)])
def test_relative(spark, text, n):
    assert one(spark, text, T.relative_clauses) == n


@pytest.mark.parametrize(("text", "n"), [("She had not finished.", 1), ("Never had he played", 1), ("Never had we truly laughed", 0), ("They had gone.", 1), ("She had red shoes.", 0)])
def test_past_perfect(spark, text, n):
    assert one(spark, text, T.past_perfects) == n


def test_quotes_are_exempt(spark):
    assert one(spark, 'He said "the door was opened" aloud.', lambda c: T.passives(T.strip_quotes(c))) == 0


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Mr. Hill came in. He sat down.", ["Mr. Hill came in.", "He sat down."]),
        ("J. K. Moss wrote. It sold.", ["J. K. Moss wrote.", "It sold."]),
        ("Storms. Rain fell.", ["Storms.", "Rain fell."]),
        ("", []),
        ("1. 2. 3.", []),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, text, T.sentences) == parts


def test_tokens(spark):
    assert one(spark, "The dog's-- well-known 'Tail' isn't 42!", T.tokens) == ["the", "dog", "well-known", "tail", "isn't"]
    assert one(spark, None, T.tokens) is None


@pytest.mark.parametrize(("word", "first"), [("stories", ["stories", "storie", "stori", "story"]), ("stopped", ["stopped", "stoppe", "stopp", "stoppe", "stop"])])
def test_variants(spark, word, first):
    got = one(spark, word, T.variants)
    assert all(x in got for x in first) and got[0] == word


def test_signals(spark):
    assert one(spark, "Three men met Rosa on 12.5 hills", T.signals) == ["12.5", "3", "Three", "Rosa"]


def test_annotations(spark):
    segs = spark.createDataFrame([(1, 1, "The wolf（狼） saw a well-known（著名的） wolf（野狼） and 中文 ran."), (2, 1, "none")], "doc_id long, seg_idx int, body string")
    notes = annot.annotations(segs)
    assert [(r.key, r.gloss) for r in notes.orderBy("n").collect()] == [("wolf", "狼"), ("well-known", "著名的"), ("wolf", "野狼")]
    assert [r.key for r in annot.duplicates(notes).collect()] == ["wolf"]
    assert annot.conflicts(notes).count() == 0  # one gloss contains the other
    assert annot.first_only(notes).where("key = 'wolf'").first().gloss == "狼"
    must = spark.createDataFrame([(1, "wolfs"), (1, "known"), (1, "moon")], "doc_id long, tok string")
    assert annot.coverage(must, notes).first().missing == 1
    assert one(spark, "a（注） 中文 b", annot.cjk_outside) == ["中文"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 9.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


def test_word_bounds_are_ascii(spark):
    """A marker before a letter beyond ASCII counts, as in the SQL (RE2) and the source system."""
    rows = spark.createDataFrame([("not noñdoo, gêne no",)], "base string")
    assert rows.select(F.regexp_count("base", T.ascii_bounds(r"\b(?:not|no|never|nicht|pas|ne)\b"))).first()[0] == 4


def test_marker_loss_on_other_letters(spark, tmp_path):
    from textflow.queries import QUERIES

    rows = [(1, 0, "user", "no noñdoo gêne not"), (1, 1, "assistant", "no")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["fid_marker_loss"](spark, str(tmp_path)).collect()] == [(1, 0, 4, 1, True)]


def test_arrays_are_worked_out_once(spark):
    """Exploding segments, sentences and tokens puts no filter on the arrays' sizes behind them; empty and null texts give no rows."""
    from textflow.operators import structure as S

    docs = spark.createDataFrame([(1, "en", "A cat's paw. Well-known 'tis dogs'-\n \nIt ran."), (2, "en", ""), (3, "en", None), (4, "en", "1 2")], "doc_id long, lang string, text string")
    toks = S.tokens(S.sentences(docs))
    assert "size(" not in toks._jdf.queryExecution().optimizedPlan().toString()
    assert [r.tok for r in toks.orderBy("seg_idx", "sent_idx", "tok_idx").collect()] == ["a", "cat", "paw", "well", "known", "tis", "dogs", "it", "ran"]


def test_clause_before_a_gloss(spark, tmp_path):
    """Clauses longer than 60 characters, without a gloss behind them, and with one nested or empty: as a bounded run finds them; a long one without end is read once."""
    import re
    import time

    from textflow.queries import QUERIES

    texts = ["x" * 5 + " " + "ab " * 40 + "considerable now", "one, considerable; two considerable（three）（four）", "（abc considerable（x））é considerables", "а" * 70 + " considerable", "no gloss", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = {tuple(r) for r in QUERIES["ann_phrase_types"](spark, f"{tmp_path}/a").collect()}
    noted = [re.sub("([A-Za-z]{4})([a-z]{5,})", r"\1\2（\1）", t) for t in texts]
    clauses = [(i, c) for i, t in enumerate(noted) for c in re.findall("([^,.;:!?（）]{1,60})（[^（）]{1,24}）", t)]
    assert got == {(i, w.lower()) for i, c in clauses for w in re.findall("[A-Za-z]+", c)} and len(clauses) >= 6
    spark.createDataFrame([(1, "ab " * 5_000_000)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/b/documents.parquet")
    began = time.time()
    assert QUERIES["ann_phrase_types"](spark, f"{tmp_path}/b").collect() == [] and time.time() - began < 20


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of one row group is cut into many pieces, of which one holds all rows."""
    from textflow.plans.layout import spread

    spark.range(0, 4000, 1, 1).selectExpr("id", "sha2(string(id), 512) AS text").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        t = spark.read.parquet(f"{tmp_path}/t")
        assert t.rdd.getNumPartitions() > 4 and t.groupBy(F.spark_partition_id()).count().count() == 1
        assert spread(t).groupBy(F.spark_partition_id()).count().count() >= 4
        assert spread(t.where("id < 0")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_concordance_groups_tokens_where_they_are(spark, tmp_path):
    """Tokens are neither sorted nor shuffled; two forms of a base in a sentence are one row, ids that are null or occur twice one text."""
    from textflow.queries import QUERIES

    docs = [(1, "Wolves saw a wolf. The wolf's paw, Zyx zyx."), (1, "A wolf ran home - zyx >—\t it.\n\nAgain wolves"), (None, "wolf"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "wolf the a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    rows = {(r.base, r.doc_id, r.seg_idx, r.sent_idx): (r.tok_idx, r.surface, r.unmerged) for r in run("con_build").collect()}
    assert rows["wolf", 1, 1, 1] == (1, "wolves", False) and rows["a", 1, 1, 1] == (1, "a", False)
    assert rows["wolf", 1, 1, 2] == (2, "wolf", False) and rows["zyx", 1, 1, 2] == (4, "zyx", True) and rows["wolf", None, 1, 1] == (1, "wolf", False)
    assert rows["wolf", 1, 2, 1] == (2, "wolves", False) and rows["it", 1, 1, 1] == (6, "it", True) and len(rows) == 14
    assert {(r.base, r.doc_id, r.n) for r in run("con_word_matrix").collect()} == {("wolf", 1, 3), ("a", 1, 1), ("the", 1, 1), ("wolf", None, 1)}
    entry = {r.base: (r.total, r.chapters) for r in run("con_word_entry").collect()}
    assert entry["wolf"] == (4, 1) and entry["zyx"] == (2, 1)
    for name in ("con_build", "con_word_matrix"):
        plan = run(name)._jdf.queryExecution().executedPlan().toString()
        of_tokens = [line for line in plan.split("\n") if "seg_idx" in line]
        assert of_tokens and not [line for line in of_tokens if "SortAggregate" in line or "Exchange hashpartitioning(base" in line]


def test_near_copies_stay_with_their_document(spark, tmp_path):
    """Lines behind a common phrase, near copies, ids that occur twice or are null: as the SQL has them, and only the texts are shuffled."""
    import random

    import duckdb

    from textflow.queries import ORACLES, QUERIES

    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    lines = [f"the register says on this day {' '.join(word() for _ in range(r.randint(0, 9)))}" for _ in range(300)]
    near = [" ".join(w if r.random() > 0.06 else word() for w in line.split()) for line in lines[:100] for _ in range(2)]
    one = [" ".join(word() for _ in range(40))]
    docs = [(1, "\n".join(lines + near + lines[:9])), (1, "\n \n".join(f"{x} {' '.join(word() for _ in range(15))}" for x in near[:50])), (2, "\n".join(one * 3)), (2, one[0] + " more"), (3, "a b\na b c\nA, b c!\na b c d"), (None, "\n".join(near)), (4, None), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["sim_near_dup_segments"](spark, str(tmp_path))
    want = sorted(c.sql(ORACLES["sim_near_dup_segments"]).fetchall())
    assert sorted(tuple(x) for x in df.collect()) == want and len(want) > 200
    plan = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan[1].count("Exchange") == 1 and "Join" not in plan[0]


def test_near_copies_in_small_steps(monkeypatch):
    """Whatever number of pairs is looked at together, each pair above 11/20 comes once; grams of one segment alone may be left out."""
    import random
    from collections import Counter

    import numpy as np

    from textflow.operators import near

    for step in (1 << 20, 5):
        monkeypatch.setattr(near, "STEP", step)
        for seed in range(40):
            r = random.Random(seed)
            base = [set(r.sample(range(60), r.randint(1, 20))) for _ in range(3)]
            sets = {3 * i + 1: s for i, s in enumerate({frozenset(r.choice(base) ^ set(r.sample(range(60), r.randint(0, 5)))) for _ in range(25)}) if s}
            often = Counter(x for s in sets.values() for x in s)
            rows = [(i, len(s), x) for i, s in sets.items() for x in s if seed % 2 or often[x] > 1]
            r.shuffle(rows)
            a = np.array(rows, "int32")
            got = sorted((int(p), int(q), float(j)) for block in near.like_pairs(*a.T) for p, q, j in zip(*block))
            assert got == sorted((p, q, len(s & t) / len(s | t)) for p, s in sets.items() for q, t in sets.items() if p < q and len(s & t) / len(s | t) > 0.55)


def test_concordance_rows_are_whole(spark, tmp_path):
    """The sentence's first 24 words, whether the base's first word has a gloss anywhere in it, and a capital amid it; ids that occur twice or are null as in the SQL."""
    import duckdb

    from textflow.queries import ORACLES, QUERIES

    long = "Then " + " ".join(f"w{chr(97 + i)}" for i in range(24)) + " Zyx（名字） ends."
    docs = [
        (1, f'He saw Wolves（狼） and a Wolf. The wolf\'s Paw -- It said "The End" to Mr. Zyx.\n{long}\n{long[5:]}'),
        (2, "Bare wolf here, then wolf（狼）; A'b（x）c Zyx（） zyx（open"),
        (3, "Some wolf（狼） ran."), (3, "Some wolf ran.\nMore of it."), (3, "A Wolves Wolf."), (None, "No wolf."), (None, "No Wolf（狼）."), (4, None), (5, ""),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "wolf the a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["con_build"](spark, str(tmp_path)).collect()
    at = {(r.base, r.doc_id, r.seg_idx, r.sent_idx): (r.surface, r.annotated, r.capital_mid) for r in rows}
    assert at["wolf", 1, 1, 1] == ("wolves", True, True) and at["he", 1, 1, 1] == ("he", False, False) and at["wolf", 1, 1, 2] == ("wolf", False, False) and at["paw", 1, 1, 2] == ("paw", False, True)
    assert at["it", 1, 1, 2] == ("it", False, False) and at["zyx", 1, 2, 1] == ("zyx", True, True) and at["wolf", 2, 1, 1] == ("wolf", True, False) and at["a'b", 2, 1, 1] == ("a'b", True, True) and at["zyx", 2, 1, 1] == ("zyx", True, True)
    lines = {(r.doc_id, r.seg_idx): r.sentence for r in rows}
    assert lines[1, 2] == " ".join(long.split()[:24]) + "…" and lines[1, 3] == " ".join(long.split()[1:25]) + "…" and lines[2, 1] == docs[1][1]
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = c.sql(ORACLES["con_build"])
    assert sorted((tuple(r[x] for x in rel.columns) for r in rows), key=str) == sorted(rel.fetchall(), key=str)


def test_markers_of_causes_and_contractions(spark, tmp_path):
    """Causes that are lost are a finding of their own; contractions negate, glosses don't count; as the SQL has it, null texts too."""
    import duckdb

    from textflow.queries import ORACLES, QUERIES

    texts = [
        "Because it rained, BUT so that we stay; however as a result, no.", "It rained. No.",
        "I can't, won't and didn't; nobody cannot.", "I can.", "wolf（not no never） not but（因为 because）", "not but （a（not）b no", None, "never", "İsn't maſ ſo", "in order  to", "so so so none", "so",
    ]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = {}
    for name in ("fid_marker_loss", "fid_marker_kinds"):
        df, rel = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
        got[name] = [tuple(r[x] for x in rel.columns) for r in df.collect()]
        assert sorted(got[name], key=str) == sorted(rel.fetchall(), key=str) and df.columns == rel.columns
    loss, kinds = {r[1]: r[2:] for r in got["fid_marker_loss"]}, {r[1:3]: r[3:] for r in got["fid_marker_kinds"]}
    assert loss[0] == (6, 1, True) and kinds[0, "causal"] == (5, 0, True) and kinds[0, "negation"] == (1, 1, False)
    assert loss[2] == (5, 0, True) and loss[4] == (2, 3, False) and loss[8] == (0, 0, False) and loss[10] == (4, 1, True)
    assert len(loss) == 11 and len(kinds) == 22
