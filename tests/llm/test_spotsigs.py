import hashlib

from pyspark.sql import functions as F

from textflow.llm import spotsigs as S


def write(df, tmp_path):
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def test_edited_texts(spark, docs, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 7)  # many ranges
    rows = sorted({(r[0], r[1] or "") for r in corpus}, key=lambda r: -r[0])
    got = {r.doc_id: r for r in S.op3_spotsigs(spark, write(docs.dropDuplicates(), tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == jaccard(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == jaccard(r.fingerprint, got[rows[(i + 1) % len(rows)][0]].fingerprint)
    assert got[3].fingerprint == got[65].fingerprint != "" and got[61].fingerprint == got[60].fingerprint == ""


def jaccard(a, b):
    x, y = (set(f.split(",")) - {""} for f in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_ids_far_apart_and_null(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 5)
    rows = [(i, f"text of number {i}") for i in range(40)] + [(2**60, "far"), (-(2**62), "low"), (2**62, "high")]
    nulls = [(None, f"no id {i}") for i in range(6)]
    docs = spark.createDataFrame(rows + nulls, "doc_id long, text string")
    got = S.op3_spotsigs(spark, write(docs, tmp_path)).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 49 and len(by_id) == 43
    order = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, after) in zip(order, order[1:]):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert by_id[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    spread = S.with_next(docs).groupBy("bucket").count().collect()
    assert max(r["count"] for r in spread) <= 15


def test_chain_words(spark):
    """Chains across anchors and lines, against a plain reading of the rule."""
    import random
    import re

    rng = random.Random(4)
    words = ["the", "of", "boat", "sea", "der", "Wind", "is", "x9", "and"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", "\n\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    anchors = set(S.ANCHORS)

    def plain(text):
        tokens, run = [], 0
        for line in re.sub(r"[^\w\n]+", " ", text.lower()).split("\n"):
            for k, w in enumerate(line.split()):
                if w in anchors:
                    tokens.append((True, w))
                else:
                    if k == 0:
                        tokens.append((True, ""))
                    tokens.append((False, w))
        out = set()
        for i, (mark, w) in enumerate(tokens):
            if not mark:
                continue
            chain, across = [], 0
            for is_mark, v in tokens[i + 1 :]:
                if is_mark:
                    across += 1
                    if across > S.LOOK:
                        break
                else:
                    chain.append(v)
                    across = 0
                    if len(chain) == S.CHAIN:
                        break
            if chain:
                out.add(":".join([w, *chain]))
        return out

    short = [t for t in texts if not re.search(r"(?:(?!\b(?:%s)\b)\w+[\W]+){8}" % "|".join(anchors), t.lower())]  # no run of eight words
    df = spark.createDataFrame([(t,) for t in short], "t string")
    got = [set(r[0]) for r in df.select(S.signatures(F.col("t"))).collect()]
    names = sorted(set().union(*map(plain, short)))
    hashed = dict(zip(names, (r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(F.hash("n")).collect())))
    assert len(short) > 20 and got == [{hashed[n] for n in plain(t)} for t in short]


def test_single_and_no_document(spark, docs, nothing, tmp_path):
    one = S.op3_spotsigs(spark, write(docs.where("doc_id = 4"), tmp_path / "a")).first()
    assert one.near_next == 1.0
    assert S.op3_spotsigs(spark, write(nothing, tmp_path / "b")).collect() == []


def test_pruned_pairs_are_all_pairs(docs):
    sets = {r.doc_id: set(r.sig) for r in docs.select("doc_id", S.signatures(F.col("text")).alias("sig")).distinct().collect() if r.sig}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in S.near_duplicates(docs, 0.5).collect()} == want != set()


def test_chains(spark):
    df = spark.createDataFrame([("At a rally to kick off the big event",), ("Kein Wort, kein Anker hier",)], "t string")
    sizes = [len(r[0]) for r in df.select(S.signatures(F.col("t"))).collect()]
    assert sizes[0] >= 3 and sizes[1] >= 1
