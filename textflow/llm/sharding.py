"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts are one group and never part. Groups stand in a fixed order and shards are runs of
it: binary search finds the smallest capacity that suffices, each capacity is checked
greedily, and the order is cut there. The order is by a hash of the text, so that neighbours
differ in size; a group as large as an even share of what is left is a shard of its own, before
the search.

The driver sees sums over ranges of the hash, never all groups. Groups of at least a 16,384th
of all bytes (at most as many) are units of their own; the others are summed in 2 ** 14 ranges.
Cutting between units only gives a capacity that is enough; cutting ranges anywhere gives one
that is needed; between the two lies where cuts may fall. The ranges there are summed anew in
256 parts, until each range that may hold a cut is a single group: then the search is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
ROW_BYTES = 8  # of a row besides its text
HASH_BITS, TOP_BITS, STEP_BITS = 60, 14, 8  # of a place in the order; of the first ranges; by which a range is parted
REST = HASH_BITS - TOP_BITS
SMALL = 1 << REST  # set in a key where the group is not large: within a range large groups come first


def place(text: Column) -> Column:
    """A text's place in the order: 60 bits of its md5. Two texts of one place would share a shard."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def key(at: Column, large: Column) -> Column:
    """What groups are ordered by: the range of the hash, large groups before others, the rest of the hash."""
    top, rest = F.shiftleft(F.shiftright(at, REST), REST + 1), at.bitwiseAND(F.lit(SMALL - 1))
    return top.bitwiseOR(rest).bitwiseOR(F.when(large, F.lit(0)).otherwise(F.lit(SMALL)).cast("long"))


def _least(low: int, high: int, enough: Callable[[int], bool]) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


def greedy(prefix: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Filling shard after shard: how many units the first 1, 2, ... shards hold. ``prefix``: 0, then running sums."""
    out, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        out.append(at)
    return out


def _furthest(prefix: np.ndarray, single: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Bytes that the first 1, 2, ... shards could hold if units that are not ``single`` were cut anywhere."""
    out, at = [], 0
    for _ in range(shards):
        at = min(at + capacity, int(prefix[-1]))
        i = int(np.searchsorted(prefix, at, side="right")) - 1
        if i < len(single) and single[i]:
            at = int(prefix[i])
        out.append(at)
    return out


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity with which ``shards`` runs of whole units suffice."""
    prefix = np.append(0, np.cumsum(sizes))
    return _least(max(-(-int(prefix[-1]) // shards), int(sizes.max(initial=0))), int(prefix[-1]), lambda c: greedy(prefix, shards, c)[-1] == len(sizes))


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], list[int]]:
    """The size from which a group is large, the places of groups that are shards of their own, and the first keys of the other shards.

    ``groups`` (place, size) is a written table: it is read once for each level of ranges.
    """
    whole = int(groups.agg(F.sum("size")).first()[0] or 0)
    limit = max(1, whole >> TOP_BITS)
    large = groups.where(F.col("size") >= limit).select("place", "size", key(F.col("place"), F.lit(True)).alias("key"))
    large = large.orderBy(F.desc("size"), "place").collect()  # 2 ** TOP_BITS rows at most
    own: list[int] = []
    while len(own) < min(len(large), shards - 1) and large[len(own)]["size"] * (shards - len(own)) >= whole:
        whole -= large[len(own)]["size"]
        own.append(large[len(own)]["place"])
    shards -= len(own)
    small = groups.where(F.col("size") < limit).select(key(F.col("place"), F.lit(False)).alias("key"), "size")

    def summed(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        """(first key, bits of the range, size, groups) of each range."""
        parts = rows.groupBy(F.shiftright("key", bits).alias("k")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        return [(r["k"] << bits, bits, r["size"], r["n"]) for r in parts.collect()]

    units = [(r["key"], 0, r["size"], 1) for r in large[len(own) :]] + summed(small, REST)
    while True:
        units.sort()
        sizes, single = np.array([u[2] for u in units], dtype=np.int64), np.array([u[3] == 1 for u in units], dtype=bool)
        prefix = np.append(0, np.cumsum(sizes))
        enough = least_capacity(sizes, shards)
        low = max(-(-int(prefix[-1]) // shards), int(sizes[single].max(initial=0)))
        needed = _least(low, enough, lambda c: _furthest(prefix, single, shards, c)[-1] == prefix[-1])
        first, last = greedy(prefix, shards, needed), np.searchsorted(prefix, _furthest(prefix, single, shards, enough), side="left")
        unsure = {i for a, b in zip(first, last) for i in range(a, int(b)) if not single[i]}
        if not unsure:
            break
        bits = max(units[i][1] for i in unsure)
        parted = sorted(i for i in unsure if units[i][1] == bits)
        step = min(STEP_BITS, bits)
        within = F.shiftright("key", bits).isin([units[i][0] >> bits for i in parted])
        gone = set(parted)
        units = [u for i, u in enumerate(units) if i not in gone] + summed(small.where(within), bits - step)
    starts = [units[e][0] for e in greedy(prefix, shards, enough)[:-1] if e < len(units)]
    return limit, own, starts


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (with ``place`` and ``size``) with the columns ``shard`` and ``slot``.

    Slots number a shard's rows from 0, by the order of its groups, then by all other columns.
    Rows of one place (equal texts) share a shard; repeated rows get a slot each.
    """
    columns = rows.columns
    rows = common.materialize(rows, "rows")
    groups = common.materialize(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    limit, own, starts = cuts(groups, shards)
    large = groups.where(F.col("size") >= limit).select("place", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), "place", "left")  # 2 ** TOP_BITS rows at most
    rows = rows.withColumn("key", key(F.col("place"), F.coalesce("large", F.lit(False)))).drop("large")
    number = F.lit(len(own)) + reduce(lambda a, b: a + b, ((F.col("key") >= s).cast("int") for s in starts), F.lit(0))
    for i, at in enumerate(own):
        number = F.when(F.col("place") == at, F.lit(i)).otherwise(number)
    rows = rows.withColumn("shard", number.cast("int"))
    order = ["shard", "key", *[c for c in columns if c != "place"]]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = common.materialize(rows, "sorted").withColumn("range", F.shiftrightunsigned("row", 33))
    ranges = rows.groupBy("shard", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("shard", "range", (before - F.col("first")).alias("shift"))
    return rows.join(ranges, ["shard", "range"]).select(*columns, "shard", (F.col("row") + F.col("shift")).alias("slot"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``documents``.

    A null text is an empty one. Null and repeated ids are rows like others; an empty table
    gives no row; further columns are not read.
    """
    docs = common.table(spark, sf_dir, "documents")
    text = common.text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(text).alias("place"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_sharding": op13_sharding}
ORACLES = {
    "op13_sharding": f"""
WITH RECURSIVE
bits AS (SELECT unnest(range(256)) AS b, b AS c, 0 AS i UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
docs AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, CAST('0x' || md5(coalesce(text, ''))[:15] AS BIGINT) AS place,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc),
total AS (SELECT sum(size) AS total FROM docs),
sized AS MATERIALIZED (
  SELECT place, CAST(s AS BIGINT) AS s, CAST(total AS BIGINT) AS total, s >= greatest(1, CAST(total AS BIGINT) >> {TOP_BITS}) AS large,
    row_number() OVER (ORDER BY s DESC, place) - 1 AS r, total - coalesce(sum(s) OVER (ORDER BY s DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM (SELECT place, sum(size) AS s FROM docs GROUP BY place), total),
owned AS (SELECT *, bool_and(large AND r < {SHARDS - 1} AND s * ({SHARDS} - r) >= rest) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS own FROM sized),
keyed AS MATERIALIZED (
  SELECT *, ((place >> {REST}) << {REST + 1}) | (place & {SMALL - 1}) | CASE WHEN large THEN 0 ELSE {SMALL} END AS k,
    sum(s) FILTER (NOT own) OVER (ORDER BY ((place >> {REST}) << {REST + 1}) | (place & {SMALL - 1}) | CASE WHEN large THEN 0 ELSE {SMALL} END ROWS UNBOUNDED PRECEDING) AS upto
  FROM owned),
line AS MATERIALIZED (SELECT list(CAST(upto AS BIGINT) ORDER BY k) FILTER (NOT own) AS p, CAST(sum(s) FILTER (NOT own) AS BIGINT) AS whole, CAST({SHARDS} - count(*) FILTER (own) AS BIGINT) AS m FROM keyed),
search AS (
  SELECT CAST(1 AS BIGINT) AS lo, whole AS hi, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS j FROM line
  UNION ALL
  SELECT CASE WHEN nx < whole AND j + 1 = m THEN mid + 1 ELSE lo END, CASE WHEN nx = whole THEN mid ELSE hi END,
    CASE WHEN nx = whole OR j + 1 = m THEN 0 ELSE nx END, CASE WHEN nx = whole OR j + 1 = m THEN 0 ELSE j + 1 END
  FROM (SELECT lo, hi, j, mid, m, whole, greatest(pos, coalesce(list_max(list_filter(p, lambda x: x <= pos + mid)), 0)) AS nx
        FROM (SELECT *, (lo + hi) // 2 AS mid FROM search WHERE lo < hi), line)),
best AS (SELECT min(hi) AS c FROM search),
ends AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS j FROM line
  UNION ALL
  SELECT greatest(pos, coalesce(list_max(list_filter(p, lambda x: x <= pos + c)), 0)), j + 1 FROM ends, line, best WHERE j + 1 < m),
placed AS (
  SELECT place, k, CASE WHEN own THEN r ELSE (SELECT {SHARDS} - m FROM line) + (SELECT count(*) FROM ends WHERE j > 0 AND pos < upto) END AS shard FROM keyed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM docs JOIN placed USING (place)
"""
}
