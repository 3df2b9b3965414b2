import random

import numpy as np

from textflow.queries import QUERIES
from textflow.queries import align_queries as Q
from textflow.operators import align as A


def rows(spark, base, cur):
    side = lambda xs: spark.createDataFrame([(1, i, s) for i, s in enumerate(xs)], "pair_id long, at int, sent string")
    return {(r.kind, r.base_at, r.cur_at): r.lost_signals for r in A.align(side(base), side(cur)).collect()}


def test_lost_added_matched(spark):
    base = ["Rosa walked along the quiet river bank.", "It rained all night over the hills.", "Three boats left the harbour early."]
    cur = ["Rosa walked along the quiet river bank.", "Boats left the harbour early in the morning.", "Nobody knew why."]
    got = rows(spark, base, cur)
    assert set(got) == {("match", 0, 0), ("lost", 1, None), ("match", 2, 1), ("added", None, 2)}
    assert "3" in got[("match", 2, 1)]


def test_empty_sides(spark):
    assert set(rows(spark, ["One small lamp burns."], [])) == {("lost", 0, None)}


def test_anchors_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = A._anchors(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def walk(a, b):
    """Plain code: the whole table of suffix lengths, then the walk."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_anchors_take_the_plain_walk():
    rng = random.Random(8)
    for letters in ("ab", "abcd", "abcdefghijkl"):
        for _ in range(300):
            a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 14))] for _ in range(2))
            assert A._anchors(a, b) == walk(a, b)
    long = [str(i) for i in range(60_000)]
    assert len(A._anchors(long, long[:30_000] + ["x"] + long[30_000:])) == 60_000  # no table of three billion cells


def plain(base, cur):
    """(kind, base, cur, lost signals) of one pair; sides are rows of (key, words, signals)."""
    out = []

    def match(i, j):
        out.append(("match", i, j, tuple(dict.fromkeys(x for x in base[i][2] if x not in cur[j][2]))))

    def gap(i0, i1, j0, j1):
        free = list(range(j0, j1))
        for i in range(i0, i1):
            likes = [(len(base[i][1] & cur[j][1]) / len(base[i][1] | cur[j][1]) if base[i][1] and cur[j][1] else 0, -j) for j in free]
            best = max(likes, default=(0, 0))
            if best[0] > A.THRESHOLD:
                free.remove(-best[1])
                match(i, -best[1])
            else:
                out.append(("lost", i, None, ()))
        out.extend(("added", None, j, ()) for j in free)

    i0 = j0 = 0
    for i, j in [*walk([r[0] for r in base], [r[0] for r in cur]), (len(base), len(cur))]:
        gap(i0, i, j0, j)
        if i < len(base):
            match(i, j)
        i0, j0 = i + 1, j + 1
    return out


def test_registered_alignment_like_plain_code(spark):
    """All pairs of the smallest tables; the dossier's counts are those of its rows."""
    sf = "/root/testdata/sf0.001"
    sides = []
    for side in Q._sides(spark, sf):
        rows: dict = {}
        for r in A.features(side).orderBy("pair_id", "at").collect():
            rows.setdefault(r.pair_id, []).append((r.key, set(r.words), list(r.signals)))
        sides.append(rows)
    want = sorted(((p, *r) for p in sides[0].keys() | sides[1].keys() for r in plain(sides[0].get(p, []), sides[1].get(p, []))), key=str)
    got = [(r.pair_id, r.kind, r.base_at, r.cur_at, tuple(r.lost_signals or ())) for r in QUERIES["ver_align"](spark, sf).collect()]
    assert sorted(got, key=str) == want
    for r in QUERIES["agg_dossier"](spark, sf).collect():
        own = [x for x in want if x[0] == r.pair_id]
        assert [r[k] or 0 for k in ("match", "lost", "added")] == [sum(x[1] == k for x in own) for k in ("match", "lost", "added")]
        assert (r.signals_lost or 0) == sum(len(x[4]) for x in own)


def test_attribution_of_hard_words(spark):
    side = lambda xs: spark.createDataFrame([(p, i, s) for p, ss in xs.items() for i, s in enumerate(ss)], "pair_id long, at int, sent string")
    lexicon = spark.createDataFrame([(w, False) for w in "the old mill stood by river it rained all night over hill".split()], "word string, pending boolean")
    base = {1: ["The old mills stood by the tarn.", "It rained over dale and dell."], 2: ["The mill stood."]}
    cur = {1: ["The old mills stood by the river."], 2: ["The mill stood."]}
    got = [tuple(r) for r in A.attribution(side(base), side(cur), lexicon).collect()]
    assert got == [(1, 3, 1, 0)]  # dale, dell and and went with their sentence; tarn was rewritten; mills is a form of mill
    cur[1].append("It rained over dale and down.")
    assert [tuple(r) for r in A.attribution(side(base), side(cur), lexicon).collect()] == [(1, 0, 2, 2)]


def test_vector_coverage_like_plain_code(spark):
    rng = np.random.default_rng(4)
    rows = [(p, i, [float(x) for x in rng.normal(size=4)]) for p in (1, 2, 3) for i in range(6)]
    near = [(p, i, [x + 0.05 for x in v]) for p, i, v in rows if (p, i) not in ((1, 2), (2, 0)) and p < 3]
    schema = "pair_id long, at int, v array<double>"
    got = {r.pair_id: (r.units, r.covered, r.score) for r in A.vector_coverage(spark.createDataFrame(rows, schema), spark.createDataFrame(near, schema)).collect()}
    assert got[1][:2] == (6, 5) and got[2][:2] == (6, 5) and got[3] == (6, 0, 0.0)


def test_many_pairs_in_one_task(spark):
    """Pairs come to Python many at once; some have one side only, one has no id; sentences come in any order."""
    frame = lambda xs: spark.createDataFrame(xs, "pair_id long, at int, sent string")
    base = [(i, k, f"Old word{i} number {k} stays here.") for i in range(700) for k in (1, 0) if i % 7] + [(None, 0, "Alone here.")]
    cur = [(i, 0, f"Old word{i} number 0 stays here.") for i in range(700) if i % 5] + [(None, 0, "Alone here.")]
    got = A.align(frame(base).coalesce(1), frame(cur).coalesce(1))
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for i in range(700):
        if i % 7 and i % 5:
            want |= {(i, "match", 0, 0), (i, "lost", 1, None)}
        elif i % 7:
            want |= {(i, "lost", 0, None), (i, "lost", 1, None)}
        elif i % 5:
            want.add((i, "added", None, 0))
    assert {(r.pair_id, r.kind, r.base_at, r.cur_at) for r in got.collect()} == want | {(None, "match", 0, 0)}
