"""Phrase collocation mining by direct-address tiles of frequency-ranked word ids.

Texts are cut into chunks of one language, whose words are numbered by a dictionary of the
chunk's own. The words that occur often enough in their language get an id by falling
frequency, and the pairs of neighbouring ids are counted tile by tile: a tile is a rectangle of
ranks, whose sides double with the rank. A tile that holds about as many pairs as cells is
counted with one dense ``bincount``, a sparse one as sorted COO; a task adds up its chunks' counts. Longer phrases are counted in the same
way, as a phrase of one word less (ranked by its frequency in the chunk) followed by a word, and
only where both phrases that are one word shorter may be frequent. Phrases are known by their
words' ids, written as the digits of 64-bit numbers, so a chunk never asks for a phrase's number
and no rows of chunks by phrases are made.

Every group that a task holds is one chunk (``CHUNK_BYTES`` of text at most, but for a single
piece that is longer). Ids come from a range-partitioned sort, so neither words nor phrases
are ever all in one task or on the driver. The only thing that is broadcast is a bit map of
fixed size, which keeps most of the rare phrases from being counted; a bit set by chance costs a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2_000
CHUNK_BYTES = 8 << 20  # of text in a chunk
HELD_PAIRS = 3_000_000  # counts that a task holds before it puts them out
BLOCK_BYTES = 1 << 20  # of text that is split into words at a time
TILE = 256  # ranks on a side of the first tile
BITS = 27  # of a bit's number in the map of frequent phrases
KEY_BITS = 63  # of a number that holds the ids of several words
GAP = b"\xff"  # stands between pieces; no byte of UTF-8

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + GAP * len(_ENDS))


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(data: bytes) -> Iterator[bytes]:
    """Parts of about ``BLOCK_BYTES``, cut between pieces only."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        cut = data.rfind(GAP, at + 1, at + BLOCK_BYTES)
        cut = data.find(GAP, at + BLOCK_BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks: rows with a block of word numbers (``codes``), and rows with a word of the chunk's dictionary and its count."""
    base, made = TaskContext.get().partitionId() << 32, 0
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> Iterator[pd.DataFrame]:
        nonlocal made
        numbers, blocks, part, held = _Numbers({GAP: 0}), [], [], 0
        for data in [*waiting.pop(lang), None]:
            if part and (data is None or held + len(data) > BLOCK_BYTES):
                words = GAP.join(part).replace(GAP, b" \xff ").split()
                blocks.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                part, held = [], 0
            if data is not None:
                part.append(data)
                held += len(data)
        size.pop(lang)
        chunk, made = base + made, made + 1
        n = reduce(np.add, (np.bincount(b, minlength=len(numbers)) for b in blocks))
        words = list(numbers)
        for at in range(1, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pd.DataFrame({"chunk": chunk, "lang": lang, "at": np.arange(at, at + len(some), dtype=np.int32), "word": some, "n": n[at : at + len(some)], "codes": None})
        for at, block in enumerate(blocks):
            yield pd.DataFrame({"chunk": [chunk], "lang": [lang], "at": np.array([at], np.int32), "word": [None], "n": [0], "codes": [block.tobytes()]})

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            for data in _blocks(text.encode("utf-8", "surrogatepass").translate(_TABLE)):
                waiting.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
                if size[lang] >= CHUNK_BYTES:
                    yield from flush(lang)
        if sum(size.values()) > 4 * CHUNK_BYTES:  # many languages at once
            for lang in list(size):
                yield from flush(lang)
    for lang in list(size):
        yield from flush(lang)


def _side(rank: np.ndarray) -> np.ndarray:
    """The band of a rank: 0 below ``TILE``, and one more wherever the ranks have doubled."""
    return np.frexp((rank // TILE).astype(np.float64))[1]


def _keys(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    if len(left) and (int(left.max()) + 1) * base >= 1 << 63:
        raise OverflowError("more phrases times words than a 64-bit key holds")
    return left * base + right


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids and their counts, tile by tile."""
    if not len(left):
        return left, right, left
    tile = (_side(left) * 64 + _side(right)).astype(np.int16)
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    ends = np.append(np.flatnonzero(np.diff(tile)) + 1, len(tile))
    out: list[tuple] = []
    start = 0
    for end in ends:
        l, r = left[start:end], right[start:end]
        (from_l, wide_l), (from_r, wide_r) = ((0, TILE) if s == 0 else (TILE << (s - 1), TILE << (s - 1)) for s in (int(tile[start]) >> 6, int(tile[start]) & 63))
        if wide_l * wide_r <= 2 * (end - start):  # dense
            n = np.bincount((l - from_l) * wide_r + (r - from_r), minlength=1)
            cell = np.flatnonzero(n)
            out.append((cell // wide_r + from_l, cell % wide_r + from_r, n[cell]))
        else:  # sorted COO
            key, n = _merged(_keys(l, r, from_r + wide_r), None)
            out.append((key // (from_r + wide_r), key % (from_r + wide_r), n))
        start = end
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts (1 each, if not given)."""
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first) if len(first) else n


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype(np.int32 if not len(ids) or ids.max() < 1 << 31 else np.int64).tobytes() + (b"4" if not len(ids) or ids.max() < 1 << 31 else b"8")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32 if data[-1:] == b"4" else np.int64, (len(data) - 1) // int(data[-1:])).astype(np.int64)


_LEVEL = "chunk long, words binary"
_NOTHING = pd.DataFrame({c.split()[0]: np.empty(0, object) for c in _LEVEL.split(", ")})


def _level(chunk: int, words: np.ndarray, ids: np.ndarray, n: int) -> pd.DataFrame:
    """A chunk's words as one row; ``ids`` has the phrases of n words that start at them (-1 where none is frequent).

    Words that no such phrase covers are left out, but for one place after each run.
    """
    covered = ids >= 0
    for k in range(1, min(n, len(ids))):  # word i is part of a phrase that starts up to n - 1 words before
        covered[k:] |= ids[:-k] >= 0
    keep = covered | np.append(False, covered[:-1]) if len(ids) else covered
    return pd.DataFrame({"chunk": [chunk], "words": [_packed(np.where(covered, words, -1)[keep])]})


def _width(base: int) -> int:
    """How many ids below ``base`` one number holds."""
    k = 1
    while base ** (k + 1) < 1 << KEY_BITS and k < KEY_BITS:
        k += 1
    return k


def _names(n: int, width: int) -> list[str]:
    """Columns of the numbers that name a phrase of n words, ``width`` words each."""
    return ["pair", *(f"pair{j}" for j in range(1, -(-n // width)))]


def _numbers(words: np.ndarray, starts: np.ndarray, n: int, base: int, width: int) -> list[np.ndarray]:
    """The numbers of the phrases of n words that start there."""
    out: list[np.ndarray] = []
    for k in range(n):
        out = _longer(out, words[starts + k], k, base, width)
    return out


def _longer(numbers: list[np.ndarray], right: np.ndarray, n: int, base: int, width: int) -> list[np.ndarray]:
    """The numbers of phrases of n words, each followed by one more word."""
    return [*numbers, right] if n % width == 0 else [*numbers[:-1], _keys(numbers[-1], right, base)]


def _ranks(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of phrases by falling frequency among those given, and a place of each rank."""
    key = numbers[0]
    for more in numbers[1:]:
        _, key = np.unique(key, return_inverse=True)
        _, other = np.unique(more, return_inverse=True)
        key = _keys(key, other, len(other) + 1)
    _, place, key, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[key], place[order]


def _summed(numbers: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``_merged``, for phrases of one or more numbers."""
    if len(numbers) == 1:
        key, n = _merged(numbers[0], n)
        return [key], n
    order = np.lexsort(numbers[::-1])
    numbers, n = [x[order] for x in numbers], n[order]
    new = reduce(np.logical_or, (np.diff(x) != 0 for x in numbers))
    first = np.flatnonzero(np.append(True, new)) if len(n) else np.empty(0, np.int64)
    return [x[first] for x in numbers], np.add.reduceat(n, first) if len(first) else n


def _starts(words: np.ndarray, n: int, base: int, width: int, bits: np.ndarray | None) -> np.ndarray:
    """Where phrases of n + 1 words may start: both phrases of n words in it may be frequent."""
    if len(words) <= n:
        return np.empty(0, np.int64)
    places = len(words) - n + 1
    likely = reduce(np.logical_and, (words[k : k + places] >= 0 for k in range(n)))
    if bits is not None:
        at = np.flatnonzero(likely)
        bit = _bit(_numbers(words, at, n, base, width), 8 * len(bits))
        likely[at] = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(likely[:-1] & likely[1:])


def _counts(n: int, base: int, width: int | None = None, shared=None):
    """Counts of phrases of n + 1 words over the chunks of a task, put together before they leave it."""
    width = width or _width(base)
    names = _names(n + 1, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def merged() -> tuple[list[np.ndarray], np.ndarray]:
            if not held:
                return [np.empty(0, np.int64)] * len(names), np.empty(0, np.int64)
            return _summed([np.concatenate(x) for x in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held]))

        def out(numbers: list[np.ndarray], count: np.ndarray) -> Iterator[pd.DataFrame]:
            for at in range(0, len(count), 200_000):
                yield pd.DataFrame({name: x[at : at + 200_000] for name, x in zip([*names, "n"], [*numbers, count])})

        for pdf in batches:
            for data in pdf["words"]:
                words = _unpacked(data)
                starts = _starts(words, n, base, width, None if shared is None else shared.value)
                left, right = _numbers(words, starts, n, base, width), words[starts + n]
                if n == 1:  # ids are ranks
                    l, r, c = tile_counts(left[0], right)
                    left = [l]
                else:
                    rank, place = _ranks(left)
                    l, r, c = tile_counts(rank, right)
                    left = [x[place[l]] for x in left]
                held.append((_longer(left, r, n, base, width), c))
                if sum(len(c) for _, c in held) > HELD_PAIRS:
                    numbers, count = merged()
                    held.clear()
                    if len(count) > HELD_PAIRS // 2:
                        yield from out(numbers, count)
                    else:
                        held.append((numbers, count))
        yield from out(*merged())

    return run


def _first(codes: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """A chunk's word numbers to ids."""
    if not len(codes) or not len(known):
        return _NOTHING.copy()
    codes = codes.sort_values("at")
    parts = []
    for block in codes["codes"]:  # blocks are cut between pieces: number 0 stands there
        parts += [np.zeros(1, np.int32), np.frombuffer(block, np.int32)]
    numbers = np.concatenate(parts)
    to = np.full(max(int(numbers.max()), int(known["at"].max())) + 1, -1, dtype=np.int64)
    to[known["at"]] = known["id"]
    words = to[numbers]
    return _level(int(codes["chunk"].iloc[0]), words, words, 1)


def _bit(numbers: list[np.ndarray], size: int) -> np.ndarray:
    """The bit of each phrase in a map of ``size`` bits, a power of two."""
    h = np.zeros(len(numbers[0]), dtype=np.uint64)
    for x in numbers:
        h ^= x.astype(np.uint64)
        for mix in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(mix)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(size - 1)).astype(np.int64)


def _bits(names: list[str], size: int):
    """Parts of 64 bits of the map that has a bit for each phrase."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bit = np.unique(_bit([pdf[name].to_numpy(np.int64) for name in names], size))
            part, first = np.unique(bit >> 6, return_index=True)
            ones = np.uint64(1) << (bit & 63).astype(np.uint64)
            yield pd.DataFrame({"part": part, "bits": (np.bitwise_or.reduceat(ones, first) if len(bit) else ones).view(np.int64)})

    return run


def ranked(df: DataFrame, n: Column, *order: str) -> DataFrame:
    """``df`` with ``id``: 0, 1, ... by falling ``n``, then ``order``.

    A sort over ranges of rows; only the sizes of these ranges are put together.
    """
    by = [n.desc(), *[F.col(c) for c in order]]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "ranks").withColumn("range", F.shiftrightunsigned("row", 33))
    ranges = rows.groupBy("range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return rows.join(ranges.select("range", (before - F.col("first")).alias("shift")), "range").withColumn("id", F.col("row") + F.col("shift")).drop("row", "range", "shift")


def _written(df: DataFrame, name: str) -> Callable[[], DataFrame]:
    """As ``materialize``, in small row groups: a row may hold a chunk's ids, and a reader takes a row group at a time.

    Each call reads the table anew, so that two parts of it can meet in a join.
    """
    path = f"{common.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return lambda: df.sparkSession.read.schema(df.schema).parquet(path)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``max_words`` words that occur ``min_count`` times or more: lang, ids, phrase (bytes), a; and each lang's number of words.

    ``docs`` has lang (null: ``und``) and text (null: empty).
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), common.text_or_empty().alias("text"))
    coded = _written(texts.mapInPandas(_coded, "chunk long, lang string, at int, word binary, n long, codes binary"), "coded")
    own = coded().where("word IS NOT NULL").select("chunk", "lang", "at", "word", "n")
    counts = own.groupBy("lang", "word").agg(F.sum("n").alias("a"))
    totals = own.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = common.materialize(ranked(counts.where(F.col("a") >= min_count), F.col("a"), "lang", "word"), "words")
    base = max(1, vocabulary.count())
    width = _width(base)
    known = own.join(vocabulary, ["lang", "word"]).select("chunk", "at", "id")
    level = vocabulary.select("lang", F.array("id").alias("ids"), F.col("word").alias("phrase"), "a", F.col("id").alias("pair"))
    word = vocabulary.select(F.col("id").alias("right"), "word")
    found = [level.drop("pair")]
    codes = coded().where("codes IS NOT NULL").select("chunk", "at", "codes")
    table = _written(codes.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_first, _LEVEL), "words-of-chunks")
    shared = None
    for n in range(1, max_words):  # from phrases of n words to those of n + 1
        names, before = _names(n + 1, width), _names(n, width)
        counts = table().select("words").mapInPandas(_counts(n, base, width, shared), ", ".join(f"{name} long" for name in [*names, "n"]))
        frequent = common.materialize(counts.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= min_count), f"frequent{n}")
        last = F.col(names[-1])  # its last digit is the last word, the others belong to the phrase before it
        alone = len(names) > len(before)
        keys = {f"left_{b}": F.col(b) if alone or b != names[-1] else F.expr(f"{b} DIV {base}") for b in before}
        shorter = level.select("lang", "ids", "phrase", *(F.col(b).alias(f"left_{b}") for b in before))
        longer = frequent.withColumns({**keys, "right": last if alone else last % base}).join(shorter, list(keys)).join(word, "right")
        level = common.materialize(longer.select("lang", F.concat("ids", F.array("right")).alias("ids"), F.concat("phrase", F.lit(b" "), "word").alias("phrase"), "a", *names), f"phrases{n}")
        found.append(level.drop(*names))
        if n + 1 < max_words:  # the map in parts of 64 bits: 2 ** (BITS - 6) rows at most
            made = frequent.select(*names).mapInPandas(_bits(names, 1 << BITS), "part long, bits long").groupBy("part").agg(F.bit_or("bits").alias("bits")).toPandas()
            bits = np.zeros(1 << (BITS - 6), dtype="<i8")
            bits[made["part"].to_numpy(np.int64)] = made["bits"].to_numpy(np.int64)
            shared = spark.sparkContext.broadcast(bits.view(np.uint8))
    return reduce(DataFrame.unionByName, found), totals


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, inside: int = 80) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    A candidate that lies inside a longer one with at least ``inside`` hundredths of its
    occurrences is dropped. Repeated rows count each; equal scores are ordered by a, then by
    the phrase's bytes. Empty tables and texts give no row; further columns are not read.
    """
    every, totals = phrases(docs, min_count, max_words)
    candidates = every.where(F.size("ids") > 1)
    cuts = candidates.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    of = lambda part, name: every.select("lang", F.col("ids").alias(part), F.col("a").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + r) AS BIGINT)")
    lowest = cuts.select("lang", "ids", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "ids").agg(F.min("cut").alias("cut"))
    size = F.size("ids")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    inner = candidates.where(size > 2).select("lang", F.explode(F.array_distinct(parts)).alias("ids"), "a").groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, ["lang", "ids"], "left").where(F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) < {int(inside)} * CAST(a AS DECIMAL(19,0))"))
    kept = kept.join(lowest, ["lang", "ids"]).select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each lang of ``documents``, from all its whole texts (see ``mine`` for odd rows)."""
    return mine(common.table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM cand c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + p - 1], ' ') AS part
    FROM cand, (SELECT unnest([2, 3]) AS p), (SELECT unnest([1, 2, 3]) AS i) WHERE p < m AND i + p - 1 <= m) GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_parts p ON p.lang = l.lang AND p.part = l.phrase
  WHERE p.longer IS NULL OR 100 * p.longer < 80 * l.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN total USING (lang) WHERE rank <= 2000
"""
}
