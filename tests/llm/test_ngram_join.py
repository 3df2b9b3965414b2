from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from textflow.llm import ngram_join as J


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").lower().split()
        sets[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k] or k, k)
    cls = {k: first[sets[k] or k] for k in sets}
    reps, links, parent = sorted(set(cls.values())), defaultdict(int), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(reps, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (cls[k], links[cls[k]], root(cls[k])) for k in sets}


def test_same_as_brute_force(docs, corpus):
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in J.join(docs).collect()}
    assert got == brute({r[0]: r[1] for r in corpus}.items())


@pytest.mark.parametrize("named", [4_096, 0])
def test_crowded_nodes_split(spark, monkeypatch, named):
    """Crowded nodes named in a filter, and (where they are too many for that) joined."""
    monkeypatch.setattr(J, "HOT_NODES", named)
    monkeypatch.setattr(J, "NODE_ROWS", 8)
    monkeypatch.setattr(J, "TILE_ROWS", 4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " " + passage) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 40, 3)]
    rows += [(200 + i, " ".join(f"z{k}" for k in range(200) if k != 7 * i)) for i in range(20)]
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_no_link_lost_behind_a_common_passage(spark):
    """With production parameters: 600 texts share a passage of a third to nine tenths of their words."""
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(300):
        own = [word() for _ in range([180, 90, 10][i % 3])]
        rows.append((i, " ".join(own + passage)))
        near = list(own)
        near[int(rng.integers(0, len(near)))] = "edited"
        rows.append((1000 + i, " ".join(near + passage)))
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    want = brute(rows)
    assert sum(v[1] for v in want.values()) > 600
    assert got == want


def test_empty_table(nothing):
    assert J.join(nothing).collect() == []


def test_shingles_and_sketches():
    p = J._Powers()
    assert len(J.shingles(None, p)) == len(J.shingles("  ", p)) == 0 and len(J.shingles("one two", p)) == 1
    a = J.shingles(" ".join(map(str, range(500))), p)
    assert len(a) == 496 and np.array_equal(a, J.shingles(" ".join(map(str, range(500))).upper() + " ", p))
    bits = lambda s: np.frombuffer(J.sketch(s)[0], dtype=np.uint64)
    far = lambda x, y: int(np.bitwise_count(bits(x) ^ bits(y)).sum())
    rng = np.random.default_rng(3)
    other = rng.integers(0, 2**63, 496).astype(np.uint64)
    assert far(a, a) == 0 and far(a, np.sort(a[:450])) < J._LIMIT < far(a, other)


def test_labels_of_long_chains(spark, monkeypatch):
    """Ids that fall away from the smallest, and ids in no order: one label each, in a few rounds."""
    monkeypatch.setattr(J, "ROUNDS", 20, raising=False)
    ids = [0, *range(499, 0, -1)]
    mixed = [1000 + int(i) for i in np.random.default_rng(5).permutation(500)]
    edges = [*zip(ids, ids[1:]), *zip(mixed, mixed[1:])]
    got = {r.id: r.root for r in J.components(spark.createDataFrame(edges, "cls long, root long")).collect()}
    assert got == {i: 0 for i in ids} | {i: 1000 for i in mixed}


def test_labels_that_stay_unsettled_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(J, "ROUNDS", 2, raising=False)
    edges = [(i, i + 1) for i in range(100)]
    with pytest.raises(RuntimeError):
        J.components(spark.createDataFrame(edges, "cls long, root long"))
