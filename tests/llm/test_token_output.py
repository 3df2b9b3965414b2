import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from textflow.llm import token_output as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_coder_round_trips():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, hi, n) for hi in (2, 50, 65536) for n in (1, 2, 77, 900)]
    codes = T.encode_blocks(blocks)
    back = T.decode_blocks(codes, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    same = T.encode_blocks([np.tile([5, 9, 700], 1000)])[0]
    assert len(same) < 600  # 3,000 ids that the contexts learn to predict


def test_words_give_the_tokenizers_ids():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "Σ", "é", "́", " ", "\n", "\t", " ", "<|endoftext|>", "'s", "1", ".", "中"]) for _ in range(rng.randint(0, 15))) for _ in range(500)]
    w = T.WordTokens(PATH, most=50)
    want = [e.ids + [T.END_ID] for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for part in (texts[:250], texts[250:]) for x in w.encode(part)] == want


def test_files_hold_every_document(spark, docs, corpus, tmp_path):
    T.write(docs, f"file://{tmp_path}/tokens", PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read(spark, f"file://{tmp_path}/tokens").collect())
    tok, at, want = T.WordTokens(PATH).tokenizer, 0, []
    for doc_id, text in sorted((r[0], r[1] or "") for r in corpus):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [T.END_ID], dtype="<u4")
        want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_damage_is_noticed(spark, docs, tmp_path):
    rows = T.pack([(np.array([1, 2, 3]), 0, 3)], 0, T.encode_blocks([np.array([1, 2, 4])])[0])
    bad = spark.createDataFrame([(0, 0, 3, ["7"], rows)], T.BLOCK_SCHEMA)
    bad.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="damaged"):
        T.read(spark, f"file://{tmp_path}/bad").collect()


def test_empty_table(spark, nothing, tmp_path):
    T.write(nothing, f"file://{tmp_path}/none", PATH)
    assert T.read(spark, f"file://{tmp_path}/none").collect() == []


def test_checksums_join():
    rng = random.Random(1)
    for _ in range(30):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 3000))
        assert T.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_long_documents_and_exact_ids(spark, tmp_path, monkeypatch):
    """Documents over several blocks; a null id beside ids that no double can hold; a repeated row."""
    monkeypatch.setattr(T, "BLOCK_IDS", 16)
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["sea", "boat", "wind", "xyzzy"]) for _ in range(n))
    rows = [(None, text(50)), (-(2**62) - 1, None), (5, text(3)), (5, ""), (6, text(400)), (7, text(20)), (2**60 + 1, text(33)), (2**60 + 3, text(1)), (2**60 + 3, text(90))]
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, payload string").coalesce(1)
    T.write(df, f"file://{tmp_path}/t", PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read(spark, f"file://{tmp_path}/t").collect())
    tok = T.WordTokens(PATH).tokenizer
    one = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [T.END_ID], dtype="<u4")
    assert sorted([(r[1] is not None, r[1] or 0, r[2], r[3]) for r in got]) == sorted((i is not None, i or 0, len(one(t)), zlib.crc32(one(t).tobytes())) for i, t in rows)
    assert [r[0] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])
    assert [r[1] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in T.op2_token_output(spark, sf).collect()}
    tok, at = T.WordTokens(PATH).tokenizer, 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [T.END_ID], dtype="<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
