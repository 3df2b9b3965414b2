"""Order-dependent comparison of two versions of a text, a pair at a time.

Pairs are spread over the cluster by a join; only the dynamic programme of one pair runs
in Python, on features that Spark has worked out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexicon as L

THRESHOLD = 0.45
ROWS = "pair_id LONG, kind STRING, base_at INT, cur_at INT, lost_signals ARRAY<STRING>"


def features(sents: DataFrame) -> DataFrame:
    """pair_id, at, sent -> with key, content words and signals."""
    s = F.col("sent")
    return sents.select("pair_id", "at", T.sentence_key(s).alias("key"), T.content_words(s).alias("words"), T.signals(s).alias("signals"))


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: where two elements differ, the first text moves on unless that shortens what is left.

    Only matches are looked at (Hunt and Szymanski, 1977). ``ends[k]`` is the last place of b
    (negated, so that it rises) from which k + 1 matches with the rest of a are left; each
    element of a changes some of them, and the changes are kept, so that the walk forwards
    can take them back. Memory goes with the number of matches, not with the product of lengths.
    """
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    changes: list[list[tuple[int, int | None]]] = [[] for _ in a]
    for i in range(len(a) - 1, -1, -1):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, -j)
            if k == len(ends):
                changes[i].append((k, None))
                ends.append(-j)
            elif ends[k] > -j:
                changes[i].append((k, ends[k]))
                ends[k] = -j

    def back(held: list[int], i: int) -> None:
        for k, old in reversed(changes[i] if i < len(a) else []):
            if old is None:
                held.pop()
            else:
                held[k] = old

    later = list(ends)
    back(later, 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j, step = i + 1, j + 1, True
        else:
            step = bisect_right(later, -j) >= bisect_right(ends, -(j + 1))
            i, j = (i + 1, j) if step else (i, j + 1)
        if step:
            back(ends, i - 1)
            back(later, i)
    return out


def _align(base: list[dict], cur: list[dict]) -> list[tuple]:
    """(kind, base_at, cur_at, lost_signals) of one pair."""
    base, cur = sorted(base, key=itemgetter("at")), sorted(cur, key=itemgetter("at"))
    bw, cw = [set(x["words"]) for x in base], [set(x["words"]) for x in cur]
    rows = []

    def match(i: int, j: int) -> None:
        have = set(cur[j]["signals"])
        rows.append(("match", i, j, list(dict.fromkeys(x for x in base[i]["signals"] if x not in have))))

    def gap(i0: int, i1: int, j0: int, j1: int) -> None:
        free = list(range(j0, j1))
        for i in range(i0, i1):
            best, at = THRESHOLD, None
            for j in free:
                both = len(bw[i] & cw[j])
                like = both / (len(bw[i]) + len(cw[j]) - both) if bw[i] and cw[j] else 0.0
                if like > best:
                    best, at = like, j
            if at is None:
                rows.append(("lost", i, None, []))
            else:
                free.remove(at)
                match(i, at)
        rows.extend(("added", None, j, []) for j in free)

    i0 = j0 = 0
    for i, j in [*_anchors([x["key"] for x in base], [x["key"] for x in cur]), (len(base), len(cur))]:
        gap(i0, i, j0, j)
        if i < len(base):
            match(i, j)
        i0, j0 = i + 1, j + 1
    return rows


def _align_batches(batches):
    schema = pa.schema([("pair_id", pa.int64()), ("kind", pa.string()), ("base_at", pa.int32()), ("cur_at", pa.int32()), ("lost_signals", pa.list_(pa.string()))])
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        pairs = zip(*(batch.column(c).to_pylist() for c in ("pair_id", "base", "cur")))
        rows = [(pair, *row) for pair, base, cur in pairs for row in _align(base or [], cur or [])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def align(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows match / lost / added of each pair; base and cur have pair_id, at, sent.

    A pair is one row of both texts' features and Python gets many pairs at once: a frame for
    each pair would cost more than its comparison.
    """
    side = lambda df, name: features(df).groupBy(F.col("pair_id").alias(f"{name}_id")).agg(F.collect_list(F.struct("at", "key", "words", "signals")).alias(name))
    pairs = side(base, "base").join(side(cur, "cur"), F.col("base_id").eqNullSafe(F.col("cur_id")), "full")
    return pairs.select(F.coalesce("base_id", "cur_id").alias("pair_id"), "base", "cur").mapInArrow(_align_batches, ROWS)


def attribution(base: DataFrame, cur: DataFrame, lexicon: DataFrame) -> DataFrame:
    """pair_id, removed_with_sentence, removed_by_rewrite, kept: what became of the base's hard words, sentence by sentence.

    A word is hard if no form of it is in the lexicon. One that recurs in a sentence counts
    once there; a pair without hard words has no row.
    """
    words = F.explode(F.array_distinct(T.tokens(F.col("sent")))).alias("tok")
    hard = L.mark(base.select("pair_id", F.col("at").alias("base_at"), words), lexicon).where("oov").select("pair_id", "base_at", "tok")
    rows = align(base, cur).where("kind <> 'added'").select("pair_id", "base_at", "cur_at", "kind")
    now = cur.select("pair_id", F.col("at").alias("cur_at"), F.array_distinct(T.tokens(F.col("sent"))).alias("have"))
    j = hard.join(rows, ["pair_id", "base_at"]).join(now, ["pair_id", "cur_at"], "left")
    stays = F.coalesce(F.array_contains("have", F.col("tok")), F.lit(False))
    went = F.col("kind") == "lost"
    return j.groupBy("pair_id").agg(F.count_if(went).alias("removed_with_sentence"), F.count_if(~went & ~stays).alias("removed_by_rewrite"), F.count_if(~went & stays).alias("kept"))


def _cover(tau: float, gap: float):
    def run(key: tuple, base: pd.DataFrame, cur: pd.DataFrame) -> pd.DataFrame:
        base, cur = base.sort_values("at"), cur.sort_values("at")
        if not len(base) or not len(cur):
            return pd.DataFrame({"pair_id": [key[0]], "units": [len(base)], "covered": [0], "score": [0.0]})
        a, b = (np.array(x["v"].tolist(), dtype=float) for x in (base, cur))
        norm = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        s = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0) - tau
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0.0, h[i, j] + s[i, j], h[i, j + 1] - gap, h[i + 1, j] - gap)
        i, j = np.unravel_index(int(h.argmax()), h.shape)
        top, covered = float(h[i, j]), set()
        while i and j and h[i, j] > 0:
            if abs(h[i, j] - (h[i - 1, j - 1] + s[i - 1, j - 1])) < 1e-12:
                if s[i - 1, j - 1] >= 0:
                    covered.add(i)
                i, j = i - 1, j - 1
            elif abs(h[i, j] - (h[i - 1, j] - gap)) < 1e-12:
                i -= 1
            else:
                j -= 1
        return pd.DataFrame({"pair_id": [key[0]], "units": [len(a)], "covered": [len(covered)], "score": [top]})

    return run


def vector_coverage(base: DataFrame, cur: DataFrame, tau: float = 0.5, gap: float = 0.3) -> DataFrame:
    """Base units that a local alignment over cosine - tau covers; base and cur have pair_id, at, v."""
    return base.groupBy("pair_id").cogroup(cur.groupBy("pair_id")).applyInPandas(_cover(tau, gap), "pair_id LONG, units LONG, covered LONG, score DOUBLE")
