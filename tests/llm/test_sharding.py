"""Shards against a plain search over all groups, hot groups, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.llm import sharding as S

from .conftest import words


def order(texts, shards):
    """Groups in order: (place, size), and the places that are shards of their own."""
    size: dict = defaultdict(int)
    for t in texts:
        size[int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)] += len((t or "").encode()) + 8
    rest, limit = sum(size.values()), max(1, sum(size.values()) >> S.TOP_BITS)
    own = []
    for place, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if len(own) == shards - 1 or s < limit or s * (shards - len(own)) < rest:
            break
        rest -= s
        own.append(place)
    key = lambda p: (p >> S.REST, size[p] < limit, p)
    return sorted(((p, size[p]) for p in size if p not in own), key=lambda x: key(x[0])), own


def least(sizes, shards):
    """The smallest largest shard, by dynamic programming."""
    prefix = np.append(0, np.cumsum(sizes))
    best = prefix.astype(float)
    for _ in range(shards - 1):
        best = np.array([min((max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)), default=0) for i in range(len(prefix))])
    return int(best[-1])


def check(spark, texts, shards, monkeypatch, bits):
    monkeypatch.setattr(S, "TOP_BITS", bits)
    monkeypatch.setattr(S, "REST", S.HASH_BITS - bits)
    monkeypatch.setattr(S, "SMALL", 1 << (S.HASH_BITS - bits))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), S.place(text).alias("place"))
    got = sorted(S.shard(rows, shards).select("doc_id", "size", "shard", "slot").collect())
    assert [r.doc_id for r in got] == list(range(len(texts)))
    groups, own = order(texts, shards)
    sums, slots, of = defaultdict(int), defaultdict(list), {}
    for r in got:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert of.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    capacity = least([s for _, s in groups], shards - len(own))
    assert max((n for k, n in sums.items() if k >= len(own)), default=0) == (capacity if groups else 0)
    at, held, want = len(own), 0, {p: i for i, p in enumerate(own)}
    for p, s in groups:  # filled greedily, in order
        if held + s > capacity:
            at, held = at + 1, 0
        held += s
        want[p] = at
    for r in got:
        assert r.shard == want[int(hashlib.md5((texts[r.doc_id] or "").encode()).hexdigest()[:15], 16)]


@pytest.mark.parametrize(("bits", "shards"), [(14, 24), (3, 24), (2, 5)])
def test_smallest_capacity(spark, monkeypatch, bits, shards):
    """With few first ranges the search has to part them."""
    rng = random.Random(bits)
    texts = [words(rng, rng.randint(1, 40)) for _ in range(220)]
    texts += [texts[1]] * 100 + [words(rng, 900), None, "", "", "é" * 50, words(rng, 300)]  # a third of the rows are one text
    check(spark, texts, shards, monkeypatch, bits)


def test_few_groups(spark, monkeypatch):
    for texts in (["a"], ["a"] * 9, [None, "", "b", "c" * 99], ["x" * n for n in range(30)]):
        check(spark, texts, 24, monkeypatch, 14)
    nothing = spark.createDataFrame([], "doc_id long, size long, place long")
    assert S.shard(nothing).collect() == []


def test_least_capacity():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 30))]
        m = rng.randint(1, 8)
        assert S.least_capacity(np.array(sizes), m) == least(sizes, m)


def test_registered_query(spark):
    rows = S.QUERIES["op13_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and 0 <= min(r.shard for r in rows) <= max(r.shard for r in rows) < 24
