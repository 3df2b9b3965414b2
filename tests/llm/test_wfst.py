import random

import pytest
import sentencepiece

from textflow.llm import wfst_pieces as W


@pytest.fixture(scope="module")
def pair():
    path = W.default_model()
    return W.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_same_path_as_the_library(pair):
    machine, library = pair
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeéh thnio▁ \n中<>0😀") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "   a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<s></s><unk>", "x" * 5000, " " * 50]
    assert [machine.encode(t) for t in texts] == library.encode(texts, num_threads=1)


def test_decoding_undoes(pair):
    machine, _ = pair
    for t in ("Three boats", " a\tb ", "\x00é中😀", "line\n\nline"):
        assert machine.decode(machine.encode(t)) == t
    assert machine.encode(None) == machine.encode("") == [] and machine.decode([]) == ""


def test_documents(docs, corpus, nothing):
    got = {r.doc_id: r for r in W.encode_documents(docs).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len({r[0] for r in corpus})
    assert got[64].decoded == next(r[1] for r in corpus if r[0] == 64) and got[60].n_pieces == 0
    assert W.encode_documents(nothing).collect() == []


def test_ids_pass_unchanged(spark):
    """A null id beside ids that no double can hold."""
    rows = [(2**60 + 1, "a b"), (None, "c"), (2**60 + 3, None), (-(2**62) - 1, "")]
    got = W.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]


def test_registered_query(spark):
    import zlib

    import numpy as np

    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=W.default_model())
    got = {r.doc_id: r for r in W.op5_wfst_pieces(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(library.encode(r.text or ""), dtype="<u4")
        assert (got[r.doc_id].n_pieces, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def _field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2, len(value)]) + value
    return bytes([number << 3]) + bytes([value])


def test_unigram_weights_against_all_paths(tmp_path):
    """A hand-written model whose scores are costs: the path is the lightest of all segmentations."""
    import struct
    from itertools import combinations

    scores = {"\u2581": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "ba": -3.2, "aba": -6.9, "\u2581a": -3.0, "bb": -8.0, "bab": -6.0}
    piece = lambda p, score, kind: _field(1, _field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + _field(3, kind))
    data = b"".join(piece(p, s, 1) for p, s in scores.items()) + b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256))
    (tmp_path / "m").write_bytes(data + _field(2, _field(3, 1)) + _field(3, _field(3, 1) + _field(4, 0)))
    machine = W.Transducer(str(tmp_path / "m"))
    assert not machine.merges
    rng = random.Random(2)
    for _ in range(60):
        s = "\u2581" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        cuts = (c for k in range(len(s)) for c in combinations(range(1, len(s)), k))
        paths = ([s[i:j] for i, j in zip((0, *c), (*c, len(s)))] for c in cuts)
        best = min(sum(-scores[p] for p in path) for path in paths if all(p in scores for p in path))
        ids, _ = machine.shortest_paths([s])
        assert sum(machine.cost[i] for i in ids) == pytest.approx(best, abs=1e-5)
