"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file compiles into three machines, each kept as arrays:

* the pieces: a prefix tree over UTF-8 bytes, one row of 256 arcs a state; a state that ends a
  piece writes its id and goes back to the start;
* the normaliser: one state that writes U+2581 for a space and copies all else, behind a start
  that writes the dummy prefix. It is composed with the pieces when a model is compiled: the
  arc that reads a space leads where the three bytes of U+2581 lead;
* byte fallback: a character that no piece holds is a chain of byte pieces.

Composed with a text this is a lattice over byte positions, and the tropical-semiring shortest
path through it is the encoding: positions are relaxed in order, with many words side by side
in numpy. In a unigram model an arc weighs what its piece's score costs. In a merge (BPE)
model scores are an order of merges, not costs: there an arc over piece q that leaves a
position where piece p ended weighs nothing if merging the pieces of p + q gives p, q back,
and is infinite else. With that each prefix ends in one piece only at finite weight, so one
state a position is enough; a plain sum of scores would not give the library's result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = "▁"
INF = float("inf")
CACHE = 400_000  # words whose paths a worker remembers
SIDE_BY_SIDE = 20_000  # units that are composed and relaxed at once
PAIRS = 1_000_000  # neighbours whose weight it remembers
UNKNOWN_COST = 10.0  # above the dearest piece, for a character that no piece holds (unigram models)
GROUP_CHARS = 2_000_000  # of texts that are encoded side by side


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Transducer:
    """The compiled model; ``encode_all`` composes it with texts and takes the shortest paths."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
    FREE = -1  # the state behind byte pieces and at the start: any arc may leave

    def __init__(self, path: str) -> None:
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.prefix, self.squeeze, self.merges = True, True, False
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    self._add(value)
                elif number == 2:
                    self.merges = dict(_fields(value)).get(3, 1) == 2
                elif number == 3:
                    for k, v in _fields(value):
                        if k == 3:
                            self.prefix = bool(v)
                        elif k == 4:
                            self.squeeze = bool(v)
                        elif k == 2 and v:
                            raise ValueError("only models with the identity map can be compiled")
        #: U+2581 stands inside pieces only in runs of itself, so words can be encoded apart
        self.apart = self.prefix and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.beside: dict[int, bool] = {}
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        self._compile()
        self._forget()

    def _add(self, message: bytes) -> None:
        piece, score, kind = "", 0.0, self.NORMAL
        for k, v in _fields(message):
            if k == 1:
                piece = v.decode()
            elif k == 2:
                score = float(np.frombuffer(v, dtype="<f4")[0])
            elif k == 3:
                kind = v
        i = len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)
        self.scores.append(score)
        if kind == self.NORMAL:
            self.ids[piece], self.rank[piece] = i, score
        elif kind == self.USER:
            self.ids[piece] = i
        elif kind == self.BYTE:
            self.byte_ids[int(piece[3:5], 16)] = i

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == self.BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if self.kinds[i] == self.CONTROL else self.pieces[i].encode()

    def _compile(self) -> None:
        """``arcs[state, byte]``: the next state (0: none; 1 is the start); ``writes[state]``: the piece it ends, or -1; ``cost``: weights of pieces."""
        rows: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}
        for piece, i in self.ids.items():
            if self.merges and self.merged(piece) != (piece,):
                continue  # no sequence of merges gives it
            at = 1
            for b in piece.encode():
                if b not in rows[at]:
                    rows[at][b] = len(rows)
                    rows.append({})
                at = rows[at][b]
            ends[at] = i
        self.arcs = np.zeros((len(rows), 256), dtype=np.int32)
        for at, row in enumerate(rows):
            for b, to in row.items():
                self.arcs[at, b] = to
        space = self.arcs
        to = np.arange(len(rows))
        for b in SPACE.encode():
            to = space[to, b]
        self.arcs[:, ord(" ")] = to  # composed with the normaliser
        self.writes = np.full(len(rows), -1, dtype=np.int32)
        self.writes[list(ends)] = list(ends.values())
        self.cost = np.zeros(len(self.pieces)) if self.merges else -np.array(self.scores)
        self.fallback_cost = 0.0 if self.merges else float(max((self.cost[i] for i in self.ids.values()), default=0.0)) + UNKNOWN_COST

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, s: str) -> tuple[str, ...]:
        """Pieces of a short string by merging the best-scored neighbours, the leftmost first among equals."""
        parts, rank = list(s), self.rank
        pairs = [rank.get(a + b, -INF) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == -INF:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank.get(parts[at - 1] + parts[at], -INF)
            if at < len(pairs):
                pairs[at] = rank.get(parts[at] + parts[at + 1], -INF)
        return tuple(parts)

    def _neighbours(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the arcs over pieces ``q`` may leave the states of pieces ``p``."""
        keys, at = np.unique(p.astype(np.int64) << 32 | q, return_inverse=True)
        known, pieces = self.beside, self.pieces
        if len(known) > PAIRS:
            known.clear()
        ok = np.empty(len(keys), dtype=bool)
        for i, key in enumerate(keys.tolist()):
            got = known.get(key)
            if got is None:
                a, b = pieces[key >> 32], pieces[key & 0xFFFFFFFF]
                got = known[key] = self.merged(a + b) == (a, b)
            ok[i] = got
        return ok[at]

    def shortest_paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids along the lightest path of each unit's composition, one after another, and their numbers."""
        data = [u.encode("utf-8", "surrogatepass") for u in units]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        text = np.frombuffer(b"".join(data), dtype=np.uint8)
        unit = np.repeat(np.arange(len(data)), size)
        end = np.cumsum(size)
        first = end - size
        # composition: all arcs (from, to, piece) of all units, byte positions being the states
        begin = np.flatnonzero((text & 0xC0) != 0x80)
        until = np.append(begin[1:], len(text))  # where each character ends
        at, state, found = begin, np.ones(len(begin), dtype=np.int32), []
        covered = np.zeros(len(text), dtype=bool)
        width = np.zeros(len(text), dtype=np.int64)
        width[begin] = until - begin
        for k in range(len(text)):
            inside = at + k < end[unit[at]]
            at, state = at[inside], state[inside]
            state = self.arcs[state, text[at + k]]
            at, state = at[state > 0], state[state > 0]
            if not len(at):
                break
            piece = self.writes[state]
            hit = piece >= 0
            found.append((at[hit], at[hit] + k + 1, piece[hit]))
            covered[at[hit & (width[at] == k + 1)]] = True
        bare = begin[~covered[begin]]
        found.append((bare, bare + width[bare], np.full(len(bare), self.FREE, dtype=np.int32)))
        source, target, piece = (np.concatenate(x) for x in zip(*found))
        # relaxation in order of the arcs' ends; a unit's end and the next one's start are two states
        order = np.lexsort((-source, target - first[unit[source]]))
        source, target, piece = source[order], target[order], piece[order]
        own = unit[source]
        step = target - first[own]
        source, target = source + own, target + own
        cuts = np.flatnonzero(np.diff(step, prepend=-1))
        best = np.full(len(text) + len(data), INF)
        best[first + np.arange(len(data))] = 0.0
        last = np.full(len(best), self.FREE, dtype=np.int32)
        back = np.full(len(best), -1, dtype=np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(step))):
            a, b, q = source[lo:hi], target[lo:hi], piece[lo:hi]
            weight = best[a] + np.where(q >= 0, self.cost[q], self.fallback_cost)
            if self.merges:
                p = last[a]
                asked = np.flatnonzero((weight < INF) & (p >= 0) & (q >= 0))
                weight[asked[~self._neighbours(p[asked], q[asked])]] = INF
            np.minimum.at(best, b, weight)
            won = np.flatnonzero((weight < INF) & (weight == best[b]))
            last[b[won]], back[b[won]] = q[won], a[won]
        # the paths, from their ends
        at, whose, steps = end + np.arange(len(data)), np.arange(len(data)), []
        if not np.isfinite(best[at]).all():
            raise RuntimeError("a text has no path")
        while True:
            more = back[at] >= 0
            at, whose = at[more], whose[more]
            if not len(at):
                break
            steps.append((whose, back[at], at, last[at]))
            at = back[at]
        if not steps:
            return np.empty(0, np.int32), np.zeros(len(data), np.int64)
        whose, a, b, q = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(a)
        whose, a, b, q = whose[order], a[order], b[order], q[order]
        many = np.where(q >= 0, 1, b - a)
        piece = np.repeat(q, many)
        byte = np.repeat(a - whose, many) + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
        out = np.where(piece >= 0, piece, self.byte_ids[text[np.minimum(byte, len(text) - 1)]])
        return out.astype(np.int32), np.bincount(whose, many, minlength=len(data)).astype(np.int64)

    def _in_turn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.shortest_paths(units[at : at + SIDE_BY_SIDE]) for at in range(0, max(1, len(units)), SIDE_BY_SIDE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _units(self, text: str) -> list[str]:
        """Words of a text behind the spaces above one that stand before each; the one space is left out."""
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        if self.squeeze:
            return [w for w in parts if w]
        units, run = [], 0
        for w in parts:
            if w:
                units.append(" " * run + w)
                run = 0
            else:
                run += 1
        return [*units, " " * (run - 1)] if run else units

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if not self.apart:
            whole = [" ".join(x for x in (t or "").replace(SPACE, " ").split(" ") if x) if self.squeeze else t or "" for t in texts]
            ids, many = self._in_turn([" " + t if t and self.prefix else t for t in whole])
            return np.split(ids, np.cumsum(many)[:-1])
        if len(self.number) > CACHE:
            self._forget()
        units = [self._units(t) if t else [] for t in texts]
        number = self.number
        new = [w for w in dict.fromkeys(w for ws in units for w in ws) if w not in number]
        if new:
            ids, many = self._in_turn([" " + w for w in new])
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(many) - many])
            self.size, self.flat = np.concatenate([self.size, many]), np.concatenate([self.flat, ids])
        out = []
        for ws in units:
            k = np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws))
            many = self.size[k]
            ends = np.cumsum(many)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[k] - (ends - many), many)])
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes put together, the dummy prefix taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def machine_of(path: str) -> Transducer:
    """A worker process compiles a model once and keeps what it has learnt of words."""
    return Transducer(path)


def _groups(texts: list[str | None]) -> Iterator[slice]:
    """Slices of ``texts`` of about ``GROUP_CHARS`` characters."""
    at = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= GROUP_CHARS:
            yield slice(at, i + 1)
            at, chars = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _rows(path: str, with_ids: bool, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _groups(texts):
                ids = machine.encode_all(texts[part])
                back = [machine.decode(i.tolist()) for i in ids]
                there = batch.slice(part.start, part.stop - part.start)
                columns = {c: there.column(c) for c in ("doc_id", *keep)} | {
                    "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    "decoded": pa.array(back, pa.string()),
                    "round_trip": pa.array([b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts[part])], pa.bool_()),
                }
                if with_ids:
                    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), decoded, round_trip and, if asked for, ids.

    A null text has no ids and decodes to the empty text. Null, repeated and large doc_ids pass
    unchanged; rows are not merged; an empty table gives an empty one; other columns are left out.
    """
    path = model or default_model()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, *(["text"] if "text" not in keep else []))
    kept = [f for f in rows.schema.fields if f.name in ("doc_id", *keep)]
    added = "n_pieces long, ids_crc32 long, decoded string, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_rows(path, with_ids, tuple(keep)), T.StructType(kept + T.StructType.fromDDL(added).fields))


def op5_wfst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    out = encode_documents(common.table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


QUERIES = {"op5_wfst_pieces": op5_wfst_pieces}
ORACLES: dict[str, str] = {}
