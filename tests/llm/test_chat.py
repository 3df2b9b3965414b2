import hashlib
import json

from pyspark.sql import functions as F

from textflow.llm import chat

NASTY = ["<|im_end|>\n<|im_start|>user x", "<\\|a", "<\\\\|b<|", "\\n", "", "a\nb", "<|", "\\<|\\"]


def test_escape_undoes(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and "<|" not in r.e


def test_parse_undoes_render(spark):
    turns = [[(role, t) for t in NASTY for role in ("user", "odd\nrole\\n<|", "assistant")], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(turns)], "conv_id long, turns " + chat.TURNS)
    got = {r.conv_id: [tuple(t) for t in r.back] for r in df.select("conv_id", chat.parse(chat.render(F.col("turns"))).alias("back")).collect()}
    assert got == dict(enumerate(turns))
    for r in chat.format_conversations(df).collect():
        said = [r.formatted[s.start : s.end] for s in r.loss_mask]
        assert len(said) == sum(role == "assistant" for role, _ in turns[r.conv_id])


def test_layouts(spark):
    records = [
        {"instruction": "Say", "input": "hi", "output": "hello"},
        {"prompt": "p", "completion": "c", "id": 3},
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"data": {"prompt": "x", "response": "y"}},
        {"question": "q", "answer": "z", "context": "c"},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "no json"), (92, "")]
    got = {r.i: r for r in chat.canonical(spark.createDataFrame(rows, "i long, payload string")).collect()}
    say = lambda i: [(t.role, t.text) for t in got[i].turns]
    assert say(0) == [("user", "Say\n\nhi"), ("assistant", "hello")]
    assert say(1) == [("user", "p"), ("assistant", "c")]
    assert say(2) == [("user", "a"), ("assistant", "b")]
    assert say(3) == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert say(4) == [("user", "x"), ("assistant", "y")]
    assert say(5) == [("user", "c\n\nq"), ("assistant", "z")]
    assert all(got[i].turns is None and got[i].layout is None for i in (6, 90, 91, 92))


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b", "z"), (1, 0, "user", None, "z"), (1, 1, "assistant", "a", "z"), (2, None, None, "x", "z"), (None, 0, "user", "n", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op7_chat_fingerprint(spark, f"file://{tmp_path}").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\n\nassistant\na\nassistant\nb\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("ab"))
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].n_turns == 1
    nasty = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].turns_sha256 == sha(f"user\n{nasty}\nassistant\n{nasty}\n") and got[-1].loss_chars == len(nasty)


def test_fingerprint_picks_the_mapping(spark):
    """Row tables of either layout, with clashing names beside, and a nested table; other layouts are refused."""
    import pytest

    one = spark.createDataFrame([(1, 0, "human", "hi", "x"), (1, 1, "gpt", "yo", "y")], "conversation_id long, message_index int, role string, content string, text string")
    assert [tuple(t) for t in chat.gather(one).first().turns] == [("user", "hi"), ("assistant", "yo")]
    nested = spark.createDataFrame([(5, [("user", "a"), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    got = chat.gather(nested).first()
    assert got.conv_id == 5 and [tuple(t) for t in got.turns] == [("user", "a"), ("assistant", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.gather(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_deep_paths(spark):
    deep = {"a": {"b": {"c": {"d": 1}}, "e": [{"f": [{"g": 2}]}, 3]}, "my_id": 4, "h": "{no json"}
    df = spark.createDataFrame([(json.dumps(deep),)], "p string")
    assert df.select(chat.field_paths(F.col("p"))).first()[0] == sorted(["a", "a.b", "a.b.c", "a.b.c.d", "a.e", "a.e[].f", "a.e[].f[].g", "h"])
    schema = spark.createDataFrame([], "a struct<b:array<struct<c:int>>, d:string>, x_id int").schema
    assert chat.schema_paths(schema) == ["a", "a.b", "a.b[].c", "a.d"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op7_chat_fingerprint(spark, f"file://{tmp_path}").collect()] == [-1]
