"""Near copies among the segments of one document, by the Jaccard likeness of their word 3-grams.

A document's segments stay where the document is, so that no gram is shuffled. Spark leaves only
the grams that more than one segment holds, of segments that could be like another; for these the
pairs are found in Python by prefixes, so many segments with a common phrase make no table of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import structure as S

ROWS = "doc_id LONG, seg_a INT, seg_b INT, jaccard DOUBLE"
STEP = 1 << 20  # pairs, or grams of pairs, that are looked at together
MOST = (11, 20)  # likeness above 11/20: both of a pair hold more than this share of either's grams in common


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts[i]`` entries its i and its number (from 0)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(counts: np.ndarray) -> Iterator[slice]:
    """Runs of places whose counts are about ``STEP`` together, at least one place each."""
    at = 0
    upto = np.cumsum(counts)
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, end)
        at = end


def like_pairs(key: np.ndarray, n: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets a < b and their likeness, where it is above 11/20; from rows (key of a set, its size, gram), once each.

    Grams that one set alone holds may be left out; ``n`` counts them. By rising frequency, two
    like sets have one of their first n - floor(11 n / 20) grams in common; only pairs that do are compared.
    """
    part, whole = MOST
    keys, first, own = np.unique(key, return_index=True, return_inverse=True)
    size, often = n[first].astype(np.int64), np.bincount(gram)
    order = np.lexsort((gram, often[gram], own))
    own, gram = own[order], gram[order].astype(np.int64)
    held = np.bincount(own)
    start = np.cumsum(held) - held
    place = np.arange(len(own)) - start[own]
    asked = np.flatnonzero(place + (size - held)[own] < (size - size * part // whole)[own])
    by_gram = asked[np.lexsort((own[asked], gram[asked]))]  # rows of a gram side by side, sets rising
    ends = np.searchsorted(gram[by_gram], gram[by_gram], "right")
    later = ends - np.arange(len(by_gram)) - 1
    by_set = np.argsort(own[by_gram], kind="stable")
    total = np.bincount(own[by_gram], later, len(keys)).astype(np.int64)
    upto = np.searchsorted(own[by_gram][by_set], np.arange(len(keys) + 1))
    width = len(often) + 1
    known = np.sort(own * width + gram)
    for some in _blocks(total):
        rows = by_set[upto[some.start] : upto[some.stop]]
        of, k = _spread(later[rows])
        a, b = own[by_gram[rows[of]]], own[by_gram[rows[of] + 1 + k]]
        a, b = np.divmod(np.unique(a * len(keys) + b), len(keys))
        close = np.minimum(size[a], size[b]) * whole > np.maximum(size[a], size[b]) * part
        a, b = a[close], b[close]
        small, large = np.where(held[a] <= held[b], a, b), np.where(held[a] <= held[b], b, a)
        for few in _blocks(held[small]):
            of, k = _spread(held[small[few]])
            wanted = large[few][of] * width + gram[start[small[few]][of] + k]
            found = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
            both = np.bincount(of[found], minlength=few.stop - few.start)
            union = size[a[few]] + size[b[few]] - both
            like = both * whole > union * part
            yield keys[a[few]][like], keys[b[few]][like], (both / union)[like]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches))  # of one document
    gram = rows.column("x").combine_chunks().dictionary_encode().indices.to_numpy()
    doc, key, seg = rows.column("doc_id")[0].as_py(), rows.column("key").to_numpy(), rows.column("seg_idx").to_numpy()
    keys, first = np.unique(key, return_index=True)
    for a, b, like in like_pairs(key, rows.column("n").to_numpy(), gram):
        a, b = (seg[first[np.searchsorted(keys, x)]] for x in (a, b))
        a, b, like = (x[a != b] for x in (np.minimum(a, b), np.maximum(a, b), like))  # an id that occurs twice has two sets at one place
        columns = [pa.array(np.full(len(a), doc), pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(like, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seg_a", "seg_b", "jaccard"])


def near_segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg_a, seg_b, jaccard above 0.55: the first segments of two distinct gram sets; ``docs`` is dealt out by doc_id."""
    part, whole = MOST
    grams = F.array_sort(T.shingles(F.split(T.sentence_key(F.col("body")), " ")))
    sets = S.segments(docs.where("doc_id IS NOT NULL")).groupBy("doc_id", grams.alias("s")).agg(F.min("seg_idx").alias("seg_idx"))
    each = sets.withColumn("key", F.monotonically_increasing_id()).select("doc_id", "seg_idx", "key", F.size("s").alias("n"), F.explode("s").alias("x")).withColumn("h", F.xxhash64("x"))
    shared = each.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "h"))).where("f > 1").drop("f", "h")
    could = shared.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))).where(F.col("m") * whole > F.col("n") * part).drop("m")
    return could.groupBy("doc_id").applyInArrow(_pairs, ROWS)
