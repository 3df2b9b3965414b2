"""N-gram Jaccard join by chosen paths (CPSJoin, Christiani et al., 2018).

A document is the set of its five-word shingles. In each of ``RUNS`` runs a set walks into a
node for every shingle that the run's hash picks for it, so many that two sets at the
threshold share ``BRANCH`` of them on average; sets that share a picked shingle meet. A crowded
node whose sets are unlike (a passage that many texts share) is left by the sets that keep
``KEEP`` other nodes, and split for the rest on further picked shingles; all other nodes are
compared in full, in tiles of bounded size. Two sets at the threshold miss each other in all
runs with a probability under 1e-5. What meets is compared by bit sketches first, then
exactly by its shingles. Links are counted where two
sets meet first, never written out as pairs, so a large group of near copies stays as many
rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 5
SIMILARITY = 0.8
RUNS = 8
BRANCH = 4.0
KEEP = 16  # picked shingles outside crowded nodes that are enough for a set: 0.8 of them, at least, are shared at the threshold
SPLIT = 3.5  # nodes of its own that a set walks on into from a crowded one
LEVELS = 3  # splits after the first
NODE_ROWS = 256  # more sets than this in a node call for a split
TILE_ROWS = 512
HOT_NODES = 4_096  # crowded unlike nodes that a filter may name (32 KB); more of them are joined
SKETCH_WORDS = 4  # of 64 bits
ROUNDS = 200  # of label lowering; a chain of 100,000 takes 19
SKETCH_SLACK = 6.0  # standard deviations below the threshold at which a pair is still compared
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE, _WORD = 0x9E3779B97F4A7C15 | 1, U(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        return self.up, self.down


def shingles(text: str | None, powers: _Powers) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of the lower-case text.

    Words are what white space parts. A shorter text is one shingle; a text without words has none.
    """
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    space = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = powers.to(len(data) + 1)
    total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    word = _mix((total[end] - total[start]) * down[start])
    n = max(1, len(word) - WIDTH + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(WIDTH, len(word))):
        out = out * _WORD + word[k : k + n]
    return np.unique(_mix(out))


def picked(tokens: np.ndarray, node: int, branch: float = BRANCH) -> np.ndarray:
    """Shingles that a node (or run) picks for a set: those whose hash under the node is small for the set's size."""
    share = (1 + SIMILARITY) / (2 * SIMILARITY)  # shared tokens are at least 1 / share of the mean size
    limit = min(1.0, branch * share / max(1, len(tokens)))
    return tokens[(_mix(tokens ^ U(node)) >> U(11)).astype(np.float64) < limit * 2.0**53]


def _child(node: int, tokens: np.ndarray) -> np.ndarray:
    return _mix(tokens * U(3) + U(node)).view(np.int64)


def _run_seed(run: int) -> int:
    return int(_mix(np.array([run + 101], dtype=np.uint64) * U(0xA0761D6478BD642F))[0])


_MASKS = _mix(np.arange(1, 65, dtype=np.uint64) * U(0xE7037ED1A0B428DB))[:, None]


def sketch(tokens: np.ndarray) -> tuple[bytes, int]:
    """256 bits, four hashed bits of each of 64 minima (b-bit minwise hashing), and one bit of each as a long."""
    low = np.full(64, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 2048):
        h = (tokens[None, at : at + 2048] ^ _MASKS) * U(0x9E3779B97F4A7C15)
        low = np.minimum(low, ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)).min(axis=1))
    nibbles = (_mix(low) >> U(37)).astype(np.uint8) & 15
    return (nibbles[:32] << 4 | nibbles[32:]).tobytes(), int(np.packbits(nibbles & 1).view(np.int64)[0])


def _signature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = _Powers()
    seeds = [_run_seed(r) for r in range(RUNS)]
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            t = shingles(text, powers)
            if not len(t):
                out.append((doc_id, 0, 0, 0, np.empty(0, np.int64), b"", 0))
                continue
            nodes = np.concatenate([_child(s, picked(t, s)) for s in seeds])
            h = _mix(t + U(7))
            out.append((doc_id, int(np.bitwise_xor.reduce(h).view(np.int64)), int(h.sum(dtype=np.uint64).view(np.int64)), len(t), np.unique(nodes), *sketch(t)))
        yield pd.DataFrame(out, columns=["doc_id", "h1", "h2", "n", "nodes", "bits", "mini"])


def _by_node(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``keys``."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if rest and (rest[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        at = 0
        for c in cut:
            piece = pdf.iloc[at:c]
            if rest:
                piece, rest = pd.concat([*rest, piece]), []
            yield piece
            at = c
        rest.append(pdf.iloc[at:])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _first_meeting(nodes_a: list, nodes_b: list, node: int) -> np.ndarray:
    """Matrix: the two sets share ``node`` and no smaller one."""
    smaller = sorted({x for ns in (*nodes_a, *nodes_b) for x in ns if x < node})
    at = {x: i for i, x in enumerate(smaller)}

    def incidence(lists: list) -> np.ndarray:
        m = np.zeros((len(lists), max(1, len(at))), dtype=np.float32)
        for i, ns in enumerate(lists):
            m[i, [at[x] for x in ns if x < node]] = 1
        return m

    return incidence(nodes_a) @ incidence(nodes_b).T == 0


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of a tile's two sides; the last value says that both are the same block."""
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    block = g["block"].to_numpy()
    return np.flatnonzero(block == i), np.flatnonzero(block == j), i == j



# differing bits of two sketches at the threshold: 128 (1 - J) on average; a differing minimum has 2 of 4, with variance
_LIMIT = 128 * (1 - SIMILARITY) + SKETCH_SLACK * np.sqrt(64 * (5 * (1 - SIMILARITY) - 4 * (1 - SIMILARITY) ** 2))


def _small_tiles(pdf: pd.DataFrame, group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows with a plausible partner among small tiles, all tiles at once: each row against the k-th after it."""
    n, bits = pdf["n"].to_numpy(), np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), 4)
    node, nodes = pdf["node"].to_numpy(), pdf["nodes"].to_numpy()
    hit = np.zeros(len(pdf), dtype=bool)
    for k in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(size[:-k] > k) if k < len(pdf) else np.empty(0, np.int64)
        a = a[group[a] == group[a + k]]
        if not len(a):
            break
        b = a + k
        ok = np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[ok], b[ok]
        far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
        for x, y in zip(a[far <= _LIMIT], b[far <= _LIMIT]):
            if not (hit[x] and hit[y]) and min(set(nodes[x]) & set(nodes[y]), default=None) == node[x]:
                hit[x] = hit[y] = True
    return hit


def _plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets of a tile that may have a link there: (node, i, j, block, cls)."""
    keys, out = ["node", "i", "j"], ["node", "i", "j", "block", "cls"]

    def large(g: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(g)
        if not len(a) or not len(b):
            return g.iloc[:0][out]
        n = g["n"].to_numpy()
        bits = np.frombuffer(b"".join(g["bits"]), dtype=np.uint64).reshape(len(g), 4)
        na, nb = n[a][:, None], n[b][None, :]
        ok = np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb) - 1e-9
        far = np.zeros(ok.shape, dtype=np.int32)
        for k in range(4):
            far += np.bitwise_count(bits[a, k][:, None] ^ bits[b, k][None, :])
        ok &= far <= _LIMIT
        if same:
            np.fill_diagonal(ok, False)
        if ok.any():
            nodes = g["nodes"].to_numpy()
            ok &= _first_meeting(list(nodes[a]), list(nodes[b]), int(g["node"].iloc[0]))
        return g.iloc[np.unique(np.concatenate([a[ok.any(axis=1)], b[ok.any(axis=0)]]))][out]

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[keys].to_numpy()
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        size = count[group]
        whole = (pdf["i"].to_numpy() == pdf["j"].to_numpy()) & (size <= 48)
        parts = []
        if whole.any():
            small = pdf[whole]
            parts.append(small[_small_tiles(small, group[whole], size[whole])][out])
        for g in np.unique(group[~whole]):
            parts.append(large(pdf[group == g] if count[g] * 4 > len(pdf) else pdf.iloc[np.flatnonzero(group == g)]))
        return pd.concat(parts) if parts else pdf.iloc[:0][out]

    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield compared(pdf.iloc[:cut].reset_index(drop=True))
    if rest is not None and len(rest):
        yield compared(rest)


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shared tokens."""
    both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)))
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    at_a = [np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in sets_a]
    at_b = at_a if sets_b is sets_a else [np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in sets_b]

    def part(lists: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
        m = np.zeros((len(lists), hi - lo), dtype=np.float32)
        for i, x in enumerate(lists):
            m[i, x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo] = 1
        return m

    for lo in range(0, len(both), 8192):
        hi = min(len(both), lo + 8192)
        a = part(at_a, lo, hi)
        out += a @ (a if sets_b is sets_a else part(at_b, lo, hi)).T
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact comparison in each tile: (cls, links, root), root the smallest class of its connected part of the tile."""
    powers = _Powers()
    for g in _by_node(batches, ["node", "i", "j"]):
        a, b, same = _sides(g)
        if not len(a) or not len(b):
            continue
        texts = g["text"].to_numpy()
        sets_a = [shingles(t, powers) for t in texts[a]]
        sets_b = sets_a if same else [shingles(t, powers) for t in texts[b]]
        both = _overlaps(sets_a, sets_b)
        size = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :]
        ok = both >= SIMILARITY * (size - both) - 1e-6
        if same:
            np.fill_diagonal(ok, False)
        nodes = g["nodes"].to_numpy()
        ok &= _first_meeting(list(nodes[a]), list(nodes[b]), int(g["node"].iloc[0]))
        if not ok.any():
            continue
        cls = g["cls"].to_numpy()
        links = np.zeros(len(g), dtype=np.int64)
        links[a] += ok.sum(axis=1)
        if not same:
            links[b] += ok.sum(axis=0)
        root = cls.copy()
        while True:  # labels go along the links until they stay
            low_a = np.where(ok, root[b][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            new = root.copy()
            new[a] = np.minimum(new[a], low_a)
            low_b = np.where(ok, new[a][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            new[b] = np.minimum(new[b], low_b)
            if (new == root).all():
                break
            root = new
        hit = links > 0
        yield pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": root[hit]})


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of an undirected graph (cls, root): labels are lowered until no edge joins two of them.

    In each round a label's whole group is hooked to the lowest label that any of its members
    sees, so the rounds grow with the logarithm of a group's length, not with the length.
    """
    both = edges.select(F.col("cls").alias("a"), F.col("root").alias("b")).where("a <> b")
    edges = common.materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.materialize(edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    for _ in range(ROUNDS):
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        seen = common.materialize(labels.join(near, "a"), "seen")
        # for each label the lowest one next to its members, or its own label if that is lower
        own = seen.where("root < a").select(F.col("a").alias("root"), F.col("root").alias("low"))
        hooks = seen.select("root", F.col("near").alias("low")).unionByName(own).groupBy("root").agg(F.min("low").alias("low"))
        new = seen.join(hooks, "root").select("a", F.least("root", "near", "low").alias("root"), F.col("root").alias("old"))
        labels = common.materialize(new, "labels")
        if not labels.where("root <> old").limit(1).count():
            return labels.select(F.col("a").alias("id"), "root")
        labels = labels.select("a", "root")
    raise RuntimeError(f"group labels still change after {ROUNDS} rounds")


def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, n_copies, n_links, group_id.

    ``class_id`` is the smallest id among documents of the same shingle set, ``n_copies`` their
    number, ``n_links`` the number of other classes at a Jaccard of 0.8 or more, ``group_id``
    the smallest class that links lead to. Texts without words (null, empty) are classes of
    their own without links. Repeated rows of one id are one document.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    docs = docs.groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats(docs) else docs
    sigs = common.materialize(docs.mapInPandas(_signature_rows, "doc_id long, h1 long, h2 long, n int, nodes array<long>, bits binary, mini long"), "sigs")
    classes = sigs.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("n_copies"))
    classes = common.materialize(classes, "classes")
    reps = sigs.join(classes.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("cls"), "n", "nodes", "bits", "mini")
    reps = common.materialize(reps, "reps")
    # nodes that two classes or more walk into
    level = reps.select("cls", "mini", F.explode("nodes").alias("node"))
    final = None
    for depth in range(LEVELS + 1):
        count = level.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        level = common.materialize(level.join(count, "node"), "level")
        crowded = level.where(F.col("m") > NODE_ROWS)
        stay, more = level, None
        if depth < LEVELS and crowded.limit(1).count():
            split = common.materialize(_unlike(crowded), "split")
            stay, going = _parted(level, split, reps, depth == 0)
            # a set goes on by its own other picks: the share that the node's hash lets through
            walk = F.transform(F.filter("nodes", lambda x: (x != F.col("node")) & (F.pmod(F.xxhash64(F.col("node"), x), F.lit(100_000)) < 100_000 * SPLIT / F.size("nodes"))), lambda x: F.xxhash64(x, F.col("node"), F.lit("walk")))
            more = going.select("cls", "mini", F.explode(walk).alias("node"))
        final = stay.select("cls", "node", "m") if final is None else final.unionByName(stay.select("cls", "node", "m"))
        if more is None:
            break
        level = more
    final = common.materialize(final, "nodes")
    # each class with all its nodes, its size and its sketch
    own = final.groupBy("cls").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    own = common.materialize(own.join(reps.select("cls", "n", "bits"), "cls"), "own")
    # tiles: blocks of a node against each other
    blocks = F.ceil(F.col("m") / TILE_ROWS).cast("int")
    tiled = final.distinct().withColumn("block", F.pmod(F.xxhash64("cls", "node"), blocks).cast("int"))
    tiled = tiled.select("cls", "node", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    tiled = tiled.select("cls", "node", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    keys = ["node", "i", "j"]
    rows = tiled.join(own, "cls").repartition(*keys).sortWithinPartitions(*keys, "cls")
    found = rows.mapInPandas(_plausible, "node long, i int, j int, block int, cls long")
    found = common.materialize(found, "found")
    full = found.join(own.select("cls", "nodes"), "cls").join(docs.select(F.col("doc_id").alias("cls"), "text"), "cls")
    full = full.repartition(*keys).sortWithinPartitions(*keys, "cls")
    links = common.materialize(full.mapInPandas(_verified, "cls long, links long, root long"), "links")
    number = links.groupBy("cls").agg(F.sum("links").alias("n_links"))
    roots = components(links)
    classes = classes.join(number, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    out = sigs.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"], "left")
    return out.select(
        "doc_id",
        F.coalesce("cls", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "cls", "doc_id").alias("group_id"),
    )


def _unlike(crowded: DataFrame) -> DataFrame:
    """Crowded nodes whose sets are unlike: over 64 bits of minwise hashes two of them seldom agree more than by chance.

    Of m sets c have a bit: two agree on it with probability (c^2 + (m - c)^2) / m^2, and (1 + J) / 2 on average.
    """
    bits = [F.sum(F.shiftrightunsigned("mini", i).bitwiseAND(F.lit(1))) for i in range(64)]
    sums = crowded.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("m"), F.array(*bits).alias("c"))
    agree = F.aggregate("c", F.lit(0.0), lambda a, c: a + (c * c + (F.col("m") - c) * (F.col("m") - c)) / (F.col("m") * F.col("m"))) / 64
    return sums.where(2 * agree - 1 < 0.4).select("node")


def _parted(level: DataFrame, split: DataFrame, reps: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of ``level`` outside the ``split`` nodes, and the sets that walk on from those: (cls, mini, node, nodes).

    On the first level only sets that keep fewer than ``KEEP`` other nodes walk on. Few split
    nodes (counted) are taken out of the sets' arrays before anything is written a row a node.
    """
    few = split.limit(HOT_NODES + 1).collect()
    if len(few) > HOT_NODES:
        stay = level.join(split, "node", "left_anti")
        going = level.join(split, "node", "left_semi")
        if first:
            lost = going.groupBy("cls").agg(F.count(F.lit(1)).alias("lost"))
            short = lost.join(reps, "cls").where(F.size("nodes") - F.col("lost") < KEEP)
            going = going.join(short.select("cls"), "cls", "left_semi")
        return stay, going.select("cls", "mini", "node").join(reps.select("cls", "nodes"), "cls")
    named = ", ".join(f"{r['node']}L" for r in few) or "NULL"
    stay = level.where(f"node NOT IN ({named})") if few else level
    if first:
        lost = reps.select("cls", "mini", "nodes", F.expr(f"filter(nodes, x -> x IN ({named}))").alias("lost"))
        short = lost.where((F.size("lost") > 0) & (F.size("nodes") - F.size("lost") < KEEP))
        return stay, short.select("cls", "mini", F.explode("lost").alias("node"), "nodes")
    going = level.where(f"node IN ({named})").select("cls", "mini", "node")
    return stay, going.join(reps.select("cls", "nodes"), "cls")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal shingle sets and their links over all documents."""
    return join(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES: dict[str, str] = {}
