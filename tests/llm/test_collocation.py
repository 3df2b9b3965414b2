"""Phrases against brute force, tiles, chunk borders, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from textflow.llm import collocation as C

_SPLIT = str.maketrans({c: "\n" for c in ".,;:!?\n\x0b\x0c\r"} | {"\t": " "} | {chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, top, max_words=4):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in (text or "").translate(_SPLIT).split("\n"):
            w = [x for x in piece.split(" ") if x]
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    out = []
    for lang in n:
        cand = {p: a for (l, p), a in f.items() if l == lang and len(p) > 1 and a >= min_count}
        inside: dict = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        rows_ = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(rng, n=400):
    vocab = [rng.choice("bcdfgh") + rng.choice("aeioué") + rng.choice(["", "x", "Y", "\xa0", "\x1c"]) for _ in range(40)]
    rows = []
    for i in range(n):
        words = [vocab[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", " "]) for w in words)))
    rows += [("en", None), (None, ""), ("en", "the Quick fox. " * 500), ("und", "ba be " * 50), ("fr", "?! .\n\t"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize(("chunk", "block"), [(12 << 20, 1 << 20), (600, 200)])
def test_same_as_brute_force(spark, monkeypatch, chunk, block):
    """Also where chunks and blocks are cut within documents."""
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rows = texts(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "lang string, text string, n long, score double")
    got = sorted(tuple(r) for r in C.mine(docs, min_count=5, top=25).collect())
    assert got == brute(rows, 5, 25) and {r[0] for r in got} >= {"en", "de", "und"}


def test_two_words_only_and_nothing(spark):
    rows = texts(random.Random(4), 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.mine(docs, min_count=4, max_words=2, top=9).collect()) == brute(rows, 4, 9, 2)
    assert C.mine(docs.where("false")).collect() == []
    assert C.mine(docs.limit(3), min_count=1000).collect() == []


@pytest.mark.parametrize("spread", [100, 3_000, 1 << 30])
def test_tiles_count_like_a_counter(spread):
    """Dense tiles, sparse tiles and both."""
    rng = np.random.default_rng(spread)
    left, right = ((rng.random(20_000) ** 4 * spread).astype(np.int64) for _ in range(2))
    l, r, n = C.tile_counts(left, right)
    assert Counter(dict(zip(zip(l.tolist(), r.tolist()), n.tolist()))) == Counter(zip(left.tolist(), right.tolist()))
    assert all(len(x) == 0 for x in C.tile_counts(left[:0], right[:0]))


def test_ids_by_falling_frequency(spark):
    rows = [(lang, f"w{i}", (i * 7) % 13) for lang in ("a", "b") for i in range(40)]
    got = C.ranked(spark.createDataFrame(rows, "lang string, word string, a long"), C.F.col("a"), "lang", "word").collect()
    assert [(-r.a, r.lang, r.word) for r in sorted(got, key=lambda r: r.id)] == sorted((-a, l, w) for l, w, a in rows)
    assert sorted(r.id for r in got) == list(range(80))


def test_counts_are_put_out_in_parts(monkeypatch):
    """Chunks of a task add up, and a full table is put out and begun anew."""
    monkeypatch.setattr(C, "HELD_PAIRS", 60)
    rng = np.random.default_rng(9)
    want: Counter = Counter()
    rows = []
    for chunk in range(12):
        words = rng.integers(-1, 9, 50)
        rows.append(C._level(chunk, words, words, 1))
        want.update((a * 9 + b) for a, b in zip(words[:-1].tolist(), words[1:].tolist()) if a >= 0 and b >= 0)
    got: Counter = Counter()
    parts = list(C._counts(1, 9)(iter(rows)))
    for part in parts:
        got.update(dict(zip(part["pair"].tolist(), part["n"].tolist())))
    assert got == want and len(parts) > 2
    with pytest.raises(OverflowError):
        C._keys(np.array([1 << 40]), np.array([1]), 1 << 30)
    wide = np.array([-1, 1 << 40])
    assert (C._unpacked(C._packed(wide)) == wide).all() and len(C._unpacked(C._packed(wide[:0]))) == 0


def test_registered_query(spark):
    got = C.QUERIES["op11_collocations"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() > 0


@pytest.mark.parametrize("bits", [63, 12, 5])
def test_words_in_one_number_or_several(spark, monkeypatch, bits):
    """Phrases whose ids fill one, two and four numbers."""
    monkeypatch.setattr(C, "KEY_BITS", bits)
    rows = texts(random.Random(6))
    assert [len(C._names(n, C._width(60))) for n in (2, 3, 4)] == {63: [1, 1, 1], 12: [1, 2, 2], 5: [2, 3, 4]}[bits]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert sorted(tuple(r) for r in C.mine(docs, min_count=5, top=25).collect()) == brute(rows, 5, 25)


def test_a_full_map_only_costs_rows(spark, monkeypatch):
    """With 64 bits nearly all are set by chance."""
    monkeypatch.setattr(C, "BITS", 6)
    rows = texts(random.Random(7), 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.mine(docs, min_count=5, top=25).collect()) == brute(rows, 5, 25)


def test_no_rows_of_chunks_by_phrases(spark, monkeypatch):
    """40 chunks that hold the same phrases: what is written between the steps is one row a chunk."""
    written = {}
    real = C._written

    def count(df, name):
        table = real(df, name)
        written[name] = (table().columns, table().count())
        return table

    monkeypatch.setattr(C, "_written", count)
    docs = spark.createDataFrame([("en", "the quick brown fox jumps over the lazy dog. " * 3)] * 400, "lang string, text string").repartition(40)
    assert C.mine(docs, min_count=5).count() > 0
    chunks = written["words-of-chunks"][1]
    assert written["words-of-chunks"][0] == ["chunk", "words"] and chunks <= 40 and not [n for n in written if n.startswith("level")]
