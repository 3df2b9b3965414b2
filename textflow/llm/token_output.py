"""Token ids to binary files: an adaptive context-mixing range coder.

Ids of whole documents, in ascending doc_id order, are cut into blocks of about
``BLOCK_IDS`` ids; a document of more than twice as many runs over several blocks. Each block
starts with an empty model and carries a checksum, so blocks are written, lost, read and
checked one by one. For each id the order-2 and the order-1 context predict an id, and order 0
knows how often an id has come in the block. Whether the predicted id follows is coded with a
probability mixed from the records of all three orders, by weights that learn; then the same
for order 1's own prediction (mixed from orders 1 and 0); an id that neither predicts is coded
by adaptive order-0 distributions over its four nibbles. The coder is a carry-less range
coder; all arithmetic is on integers, so files read the same everywhere. Numpy runs many
blocks in step.

Blocks are rows of a Parquet folder (part, seq, n_ids, doc_ids, payload). doc_ids are decimal
strings (null for a null id). The payload is ``TFC2``, number of documents, number of ids, crc32
of the ids, number of the first document within its part, then for each document how many ids
stand here, how many stood in blocks before and how many it has, then the code, all
little-endian.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_IDS = 2_048
LANES = 4_096
END_ID = 1
MAGIC = b"TFC2"
_HEAD = struct.Struct("<4sIQIQ")
BITS = 15
TOTAL = 1 << BITS
SLOTS = 10  # bits of the prediction and count tables
LAST = 256  # distributions of the last nibble
RATE = 4

# stretch(p) = ln(p / (1 - p)) and its inverse, on integers
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(np.int32)
SQUASH = np.clip(np.round(TOTAL / (1 + np.exp(-np.arange(-2304, 2305) / 256.0))), 48, TOTAL - 48).astype(np.int32)
#: where a distribution moves to when a nibble was seen: nearly all of its mass on it
_STEP = np.array([[(TOTAL - 16 * 24 if k > s else 0) + 24 * k for k in range(16)] for s in range(16)], dtype=np.int32)
_FLAT = (np.arange(16, dtype=np.int32) * (TOTAL // 16)).astype(np.int16)
M32 = np.int64(0xFFFFFFFF)
#: an id's count in the block, as one of eight records: 0, 1, 2, 3, 4.., 8.., 16.., 64..
_OFTEN = np.array([np.searchsorted([1, 2, 3, 4, 8, 16, 64], n, side="right") for n in range(256)], dtype=np.int64)


class _Coder:
    """Range coder states of many lanes; lanes are named by their numbers."""

    def __init__(self, lanes: int, room: int | None = None, data: list[np.ndarray] | None = None) -> None:
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, 0xFFFFFFFF, dtype=np.int64)
        self.at = np.zeros(lanes, dtype=np.int64)
        self.writing = data is None
        if self.writing:
            self.buffer = np.zeros((lanes, room), dtype=np.uint8)
        else:
            width = max(map(len, data)) + 16
            self.buffer = np.zeros((lanes, width), dtype=np.uint8)
            for i, d in enumerate(data):
                self.buffer[i, : len(d)] = d
            self.code = np.zeros(lanes, dtype=np.int64)
            for k in range(4):
                self.code = self.code << 8 | self.buffer[:, k]
            self.at += 4

    def value(self, i: np.ndarray) -> np.ndarray:
        """Where in the total the code of each lane stands; ``narrow`` must follow."""
        self.range[i] >>= BITS
        return np.minimum((self.code[i] - self.low[i] & M32) // self.range[i], TOTAL - 1)

    def narrow(self, i: np.ndarray, start: np.ndarray, size: np.ndarray, scaled: bool) -> None:
        r = self.range[i] if scaled else self.range[i] >> BITS
        low = self.low[i] + r * start & M32
        r = r * size
        todo = np.arange(len(i))
        lo, ra = low, r
        while True:
            same = (lo ^ (lo + ra)) < 1 << 24
            small = ~same & (ra < 1 << 16)
            go = np.flatnonzero(same | small)
            if not len(go):
                break
            todo, lo, ra = todo[go], lo[go], ra[go]
            ra = np.where(small[go], -lo & 0xFFFF, ra)
            lanes = i[todo]
            at = self.at[lanes]
            if self.writing:
                if at.max(initial=0) >= self.buffer.shape[1]:
                    self.buffer = np.pad(self.buffer, ((0, 0), (0, self.buffer.shape[1])))
                self.buffer[lanes, at] = lo >> 24
            else:
                self.code[lanes] = (self.code[lanes] << 8 | self.buffer[lanes, np.minimum(at, self.buffer.shape[1] - 1)]) & M32
            self.at[lanes] = at + 1
            lo, ra = lo << 8 & M32, ra << 8
            low[todo], r[todo] = lo, ra
        self.low[i], self.range[i] = low, r

    def bit(self, i: np.ndarray, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Codes a yes (probability p / TOTAL) or no for each of the lanes."""
        if not self.writing:
            bit = self.value(i) < p
        self.narrow(i, np.where(bit, 0, p), np.where(bit, p, TOTAL - p), not self.writing)
        return bit

    def nibble(self, i: np.ndarray, cdf: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        if not self.writing:
            n = (cdf <= self.value(i)[:, None]).sum(axis=1) - 1
        rows = np.arange(len(i))
        start = cdf[rows, n].astype(np.int64)
        end = np.where(n == 15, TOTAL, cdf[rows, np.minimum(n + 1, 15)])
        self.narrow(i, start, end - start, not self.writing)
        return n

    def finish(self) -> list[bytes]:
        for _ in range(4):
            if self.at.max(initial=0) >= self.buffer.shape[1]:
                self.buffer = np.pad(self.buffer, ((0, 0), (0, 16)))
            self.buffer[np.arange(len(self.at)), self.at] = self.low >> 24
            self.low = self.low << 8 & M32
            self.at += 1
        return [self.buffer[k, :n].tobytes() for k, n in enumerate(self.at)]


class _Mixer:
    """Probability of a yes from the records of several contexts, for each lane; records and weights learn."""

    def __init__(self, lanes: int, states: tuple[int, ...]) -> None:
        self.odds = [np.full((lanes, n), 2048, dtype=np.int32) for n in states]  # of a yes, by what the context has seen
        self.weight = np.full((len(states), lanes), (80 << 8) // len(states), dtype=np.int32)

    def code(self, coder: _Coder, i: np.ndarray, states: tuple[np.ndarray, ...], yes: np.ndarray | None) -> np.ndarray:
        odds = [o[i, s] for o, s in zip(self.odds, states)]
        pull = [STRETCH[o] for o in odds]
        weight = [w[i] for w in self.weight]
        mixed = sum(w * t for w, t in zip(weight, pull)) >> 14
        p = SQUASH[np.clip(mixed, -2304, 2304) + 2304]
        hit = coder.bit(i, p, yes)
        err = np.where(hit, TOTAL, 0) - p
        aim = np.where(hit, 4095, 0)
        for k, (o, t, w, s) in enumerate(zip(odds, pull, weight, states)):
            self.weight[k][i] = np.clip(w + (err * t >> 14), -1 << 17, 1 << 17)
            self.odds[k][i, s] = o + (aim - o >> RATE)
        return hit


def _run(coder: _Coder, lengths: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Codes all lanes' ids step by step. Lanes come longest first; reading fills and returns the ids."""
    lanes = len(lengths)
    writing = ids is not None
    if not writing:
        ids = np.zeros((lanes, int(lengths[0]) if lanes else 0), dtype=np.int32)
    slots = 1 << SLOTS
    pred = [np.full((lanes * slots), -1, dtype=np.int32) for _ in range(2)]  # order 2, order 1
    sure = [np.zeros((lanes * slots), dtype=np.int8) for _ in range(2)]
    often = np.zeros(lanes * slots, dtype=np.uint8)  # order 0
    mixers = [_Mixer(lanes, (5, 9, 8)), _Mixer(lanes, (4, 8))]
    cdf = np.empty((lanes * (273 + LAST), 16), dtype=np.int16)
    cdf[:] = _FLAT
    c1 = c2 = np.zeros(lanes, dtype=np.int64)
    slot0 = lambda i, x: i * slots + ((x.astype(np.int64) * 0x9E3779B1 >> 8) & (slots - 1))
    for t in range(ids.shape[1]):
        a = int(np.searchsorted(-lengths, -t, side="left"))  # lanes longer than t
        lane = np.arange(a)
        c1, c2 = c1[:a], c2[:a]
        h2 = lane * slots + ((c1 * 0x2F0B4C47 + c2 * 0x1E35A7BD >> 7) & (slots - 1))
        h1 = lane * slots + ((c1 * 0x9E3779B1 >> 9) & (slots - 1))
        q2, q1, k2, k1 = pred[0][h2], pred[1][h1], sure[0][h2], sure[1][h1]
        x = ids[:a, t] if writing else np.full(a, -1, dtype=np.int32)
        known = np.zeros(a, dtype=bool)
        # does order 2's prediction follow (order 1's, where order 2 has none)?
        guess = np.where(q2 >= 0, q2, q1)
        i = np.flatnonzero(guess >= 0)
        if len(i):
            g, a1 = guess[i], q1[i]
            s2 = np.where(q2[i] >= 0, k2[i], 4)
            s1 = np.where(a1 == g, 4 + k1[i], np.where(a1 >= 0, k1[i], 8))
            hit = mixers[0].code(coder, i, (s2, s1, _OFTEN[often[slot0(i, g)]]), x[i] == g if writing else None)
            known[i] = hit
            if not writing:
                x[i[hit]] = g[hit]
        # else, does order 1's?
        i = np.flatnonzero(~known & (q2 >= 0) & (q1 >= 0) & (q1 != q2))
        if len(i):
            g = q1[i]
            hit = mixers[1].code(coder, i, (k1[i], _OFTEN[often[slot0(i, g)]]), x[i] == g if writing else None)
            known[i] = hit
            if not writing:
                x[i[hit]] = g[hit]
        # else the four nibbles of the id, by order 0
        i = np.flatnonzero(~known)
        if len(i):
            base = i * (273 + LAST)
            v = x[i].astype(np.int64) if writing else None
            seen = np.zeros(len(i), dtype=np.int64)
            for k in range(4):
                row = base + (seen if k == 0 else 1 + seen if k == 1 else 17 + seen if k == 2 else 273 + (seen * 0x9E3779B1 >> 11) % LAST)
                d = cdf[row].astype(np.int32)
                n = coder.nibble(i, d, v >> 12 - 4 * k & 15 if writing else None)
                cdf[row] = d + (_STEP[n] - d >> RATE)
                seen = seen << 4 | n
            if not writing:
                x[i] = seen
        if not writing:
            ids[:a, t] = x
        h0 = slot0(lane, x)
        n0 = often[h0]
        often[h0] = n0 + (n0 < 255)
        # a right prediction is trusted more, a wrong one less; at no trust it gives way
        for table, trust, h, q, c in ((pred[0], sure[0], h2, q2, k2), (pred[1], sure[1], h1, q1, k1)):
            right = q == x
            table[h] = np.where(right | (c > 0), q, x)
            trust[h] = np.where(right, np.minimum(c + 1, 3), np.maximum(c - 1, 0))
        c2, c1 = c1, x.astype(np.int64)
    return ids


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code of each array of ids below 65,536."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    out: list[bytes] = [b""] * len(blocks)
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        lengths = np.array([len(blocks[k]) for k in lanes])
        ids = np.zeros((len(lanes), int(lengths[0])), dtype=np.int32)
        for row, k in enumerate(lanes):
            ids[row, : lengths[row]] = blocks[k]
        coder = _Coder(len(lanes), room=2 * int(lengths[0]) + 64)
        _run(coder, lengths, ids)
        for k, code in zip(lanes, coder.finish()):
            out[k] = code
    return out


def decode_blocks(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    order = sorted(range(len(codes)), key=lambda k: -lengths[k])
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(codes)
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        n = np.array([lengths[k] for k in lanes])
        coder = _Coder(len(lanes), data=[np.frombuffer(codes[k], dtype=np.uint8) for k in lanes])
        ids = _run(coder, n, None)
        for row, k in enumerate(lanes):
            out[k] = ids[row, : n[row]]
    return out


def pack(pieces: list[tuple[np.ndarray, int, int]], first: int, code: bytes) -> bytes:
    """A block's payload. A piece is (ids, ids of its document in blocks before, ids of its document)."""
    ids = np.concatenate([p[0] for p in pieces]).astype("<u4")
    sizes = np.array([(len(p[0]), p[1], p[2]) for p in pieces], dtype="<u8")
    return _HEAD.pack(MAGIC, len(pieces), len(ids), zlib.crc32(ids.tobytes()), first) + sizes.tobytes() + code


def unpack(payload: bytes) -> tuple[np.ndarray, int, int, int, bytes]:
    """(sizes, number of ids, crc32, number of the first document, code)"""
    magic, n_docs, n_ids, crc, first = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    sizes = np.frombuffer(payload, dtype="<u8", count=3 * n_docs, offset=_HEAD.size).astype(np.int64).reshape(-1, 3)
    return sizes, n_ids, crc, first, payload[_HEAD.size + 24 * n_docs :]


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if v & 1:
            out ^= row
        v >>= 1
    return out


def crc_joined(crc: int, then: int, n_bytes: int) -> int:
    """crc32 of two byte strings put together, from theirs and the second one's length."""
    shift = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit behind the first string
    n = 8 * n_bytes
    while n:
        if n & 1:
            crc = _times(shift, crc)
        shift = [_times(shift, row) for row in shift]
        n >>= 1
    return crc ^ then


class WordTokens:
    """The tokenizer's ids of whole texts, with each distinct word encoded once.

    The tokenizer drops white space and lets no token or merge reach across it, so a text's
    ids are its words' ids in order. Only blanks and line ends part words here.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [[w for w in t.replace("\n", " ").split(" ") if w] for t in texts]
        if len(self.number) > self.most:
            self._clear()
        number, new = self.number, []
        for ws in words:
            for w in ws:
                if w not in number:
                    number[w] = len(number)
                    new.append(w)
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
            size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            flat = np.fromiter((x for g in got for x in g), dtype=np.int32, count=int(size.sum()))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        out = []
        for ws in words:
            k = np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws))
            size = self.size[k]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(self.start[k] - (ends - size), size)
            out.append(np.append(self.flat[at], END_ID).astype(np.int32))
        return out


def _write_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, seq, number = TaskContext.get().partitionId(), 0, -1
        tokens = WordTokens(path)
        blocks: list[tuple[int, list, list]] = []  # number of the first document, doc ids, pieces
        ids: list = []
        pieces: list = []

        def close() -> None:
            nonlocal ids, pieces
            if pieces:
                blocks.append((number - len(pieces) + 1, ids, pieces))
            ids, pieces = [], []

        def out() -> pa.RecordBatch:
            nonlocal seq, blocks
            codes = encode_blocks([np.concatenate([p[0] for p in ps]) for _, _, ps in blocks])
            columns = [
                pa.array([part] * len(blocks), pa.int64()),
                pa.array(range(seq, seq + len(blocks)), pa.int64()),
                pa.array([sum(len(p[0]) for p in ps) for _, _, ps in blocks], pa.int64()),
                pa.array([names for _, names, _ in blocks], pa.list_(pa.string())),
                pa.array([pack(ps, first, c) for (first, _, ps), c in zip(blocks, codes)], pa.binary()),
            ]
            seq, blocks = seq + len(blocks), []
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, all_ids in zip(some.column("doc_id").to_pylist(), tokens.encode([t or "" for t in some.column("text").to_pylist()])):
                    long = len(all_ids) > 2 * BLOCK_IDS
                    if long:
                        close()
                    number += 1
                    for begin in range(0, len(all_ids), BLOCK_IDS if long else len(all_ids)):
                        ids.append(doc_id)
                        pieces.append((all_ids[begin : begin + BLOCK_IDS] if long else all_ids, begin, len(all_ids)))
                        if long or sum(len(p[0]) for p in pieces) >= BLOCK_IDS:
                            close()
                    if len(blocks) >= LANES:
                        yield out()
        close()
        if blocks:
            yield out()

    return run


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc", "doc_id", "at", "begin", "n_here", "n_tokens", "crc"]

    def out(rows: list[dict]) -> pa.RecordBatch:
        heads = [unpack(r["payload"]) for r in rows]
        blocks = decode_blocks([h[4] for h in heads], [h[1] for h in heads])
        found = []
        for r, (sizes, _, crc, first, _), block in zip(rows, heads, blocks):
            raw = block.astype("<u4").tobytes()
            if zlib.crc32(raw) != crc:
                raise ValueError(f"block {r['part']}/{r['seq']} is damaged")
            at = 0
            for k, (doc_id, (n, begin, total)) in enumerate(zip(r["doc_ids"], sizes.tolist())):
                found.append((r["part"], r["seq"], first + k, doc_id, at, begin, n, total, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                at += n
        columns = list(zip(*found)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "doc_id" else pa.int64()) for n, c in zip(names, columns)], names)

    held: list[dict] = []
    for batch in batches:
        held += batch.to_pylist()
        while len(held) >= LANES:
            yield out(held[:LANES])
            held = held[LANES:]
    if held:
        yield out(held)


def _folded(pieces: pd.Series) -> pd.Series:
    """crc32 of a document from its pieces (begin, n_here, crc) in order."""
    out = []
    for ps in pieces:
        crc = 0
        for p in ps:
            crc = crc_joined(crc, int(p["crc"]), 4 * int(p["n_here"]))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def write(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """Encodes documents and writes the files, in ascending doc_id order.

    A null text is empty; null ids come first; equal ids go by a hash of the text, so repeated
    rows stay, side by side; other columns are not written. An empty table gives an empty folder.
    """
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_write_rows(tokenizer), BLOCK_SCHEMA)
    rows.write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(folder)


BLOCK_SCHEMA = "part long, seq long, n_ids long, doc_ids array<string>, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from decoded and checked blocks."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    pieces = blocks.select("part", "seq", "doc_ids", "payload").mapInArrow(
        _read_rows, "part long, seq long, doc long, doc_id string, at long, begin long, n_here long, n_tokens long, crc long"
    )
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = blocks.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("block_start")).join(parts, "part")
    placed = common.materialize(pieces.join(starts, ["part", "seq"]).withColumn("start", F.col("part_start") + F.col("block_start") + F.col("at")), "token-pieces")
    whole = placed.where("n_here = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    cut = placed.where("n_here < n_tokens").groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.first("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("begin", "n_here", "crc"))).alias("pieces"),
    )
    cut = cut.select("doc_id", "start", "n_tokens", F.pandas_udf(_folded, "long")("pieces").alias("ids_crc32"))
    return whole.unionByName(cut).withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the files written from the whole table."""
    import uuid

    import public_tokenizers

    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder)


QUERIES = {"op2_token_output": op2_token_output}
ORACLES: dict[str, str] = {}
