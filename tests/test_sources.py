from pyspark.sql import types as T

from textflow.sources import readers as R


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_vocabulary(spark, tmp_path):
    p = write(tmp_path, "v.csv", '词,类型,词性\nLamp,单词,n\n"river, wide",短语,n\nhush,待定词,v\nrock,课标词,n\n')
    assert {(r.word, r.pending) for r in R.vocabulary(spark, p).collect()} == {("lamp", False), ("hush", True), ("rock", False)}


def test_lists(spark, tmp_path):
    p = write(tmp_path, "w.txt", "# head\n1. lamp\nriver bank\n\n---\n")
    assert {r.word for r in R.word_list(spark, p).collect()} == {"lamp", "river"}
    q = write(tmp_path, "q.csv", "word,hits\nlamp,3\n# note\nriver bank\n")
    assert {(r.word, r.hits) for r in R.learned_queue(spark, q).collect()} == {("lamp", 3), ("river bank", 1)}


def test_scaled_and_grades(spark, tmp_path):
    p = write(tmp_path, "z.tsv", "lamp\t412\nbad\tx\nzero\t0\n")
    assert [(r.word, r.value) for r in R.scaled_table(spark, p, 100).collect()] == [("lamp", 4.12)]
    g = write(tmp_path, "g.json", '{"lamp": 2, "far": 9}')
    assert [(r.word, r.value) for r in R.word_grades(spark, g, 1, 5).collect()] == [("lamp", 2.0)]


def test_ledger_rejects(spark, tmp_path):
    p = write(tmp_path, "l.jsonl", '{"schemaVersion": 1, "id": "a"}\n{bad\n{"schemaVersion": 7, "id": "b"}\n')
    rows, rejects = R.ledger(spark, p, T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("id", T.StringType())]))
    assert [r.id for r in rows.collect()] == ["a"]
    assert sorted(r.reason for r in rejects.collect()) == ["not valid JSON", "unknown schemaVersion"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("lamp", 'a "bright", thing\nhere', "x")], "word string, gloss string, source string")
    R.write_csv(df, str(tmp_path / "out"))
    assert R.dictionary(spark, str(tmp_path / "out")).collect() == df.collect()
    assert R.latest_tier_files(spark.createDataFrame([("b/A层_01_a.md",), ("b/A层_01_b.md",), ("b/A层_01_c.md.bak",)], "path string")).first().path == "b/A层_01_b.md"
