import corpus_pipeline as P
from textflow.llm import common, toxicity, wfst_pieces


def test_stages_over_edge_rows(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [(i, 1, int(i % 5 == 0)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    folder = f"file://{tmp_path}"
    now = common.table(spark, folder, "documents")
    columns = now.columns
    for name, stage in P.STAGES[:-1]:
        now = common.materialize(stage(spark, now, folder), name)
        assert now.columns == columns
    ids = [r.doc_id for r in now.collect()]
    assert 60 in ids and 61 in ids and 62 in ids
    assert len(set(ids) & set(range(40, 52))) == 1  # one of the near copies
    out = P.STAGES[-1][1](spark, now, folder)
    assert out.count() == len(ids) and out.where("NOT round_trip").count() == 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "sentencepiece"]
    assert toxicity.THRESHOLD == 0.7 and wfst_pieces.default_model()


NAMES = ("base", "rate", "copy", "tox_score", "n_copies", "steps", "was_null", "cand", "spans", "ids", "n_tokens", "label", "score")


def labels(spark, folder):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_columns_of_any_name_pass(spark, tmp_path):
    """Every stage hands on columns that are named like its own; null and repeated ids stay rows."""
    folder = labels(spark, f"file://{tmp_path}")
    rows = [(i, f"the river and the stone number {i} are of {i * i} kind", "en", 0, *(f"{c}{i}" for c in NAMES)) for i in range(30)]
    rows += [(None, "no id, mail a@b.cd", "en", 0, *NAMES), (None, None, None, None, *(None for _ in NAMES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = {tuple(r[c] for c in ("doc_id", *NAMES)) for r in out.collect()}
        assert got <= {(r[0], *r[4:]) for r in rows} and len(got) >= (20 if name == "toxicity" else 32)


def test_rows_of_one_id(spark, tmp_path):
    """One row stays, the one with the smallest text, which is also the one that is compared."""
    docs = spark.createDataFrame([(1, "b c d e f g", 1), (1, "a c d e f g", 2), (2, "b c d e f g", 3), (3, None, 4), (3, "x", 5)], "doc_id long, text string, k int")
    got = {(r.doc_id, r.text, r.k) for r in P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, "a c d e f g", 2), (2, "b c d e f g", 3), (3, "x", 5)}


def test_empty_tables(spark, nothing, tmp_path):
    folder = f"file://{tmp_path}"
    nothing.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert P.run(spark, folder).collect() == []
