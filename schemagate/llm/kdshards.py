"""Shards of equal bytes by a k-d tree over metadata: weighted medians, found by narrowing histograms.

A node of k shards is cut along its widest dimension (its range as a share of the whole table's) where the bytes
before the cut are to the bytes behind as its k // 2 left shards are to the others. Rows with one value at the cut are
ordered by a hash of their metadata, so a value that a third of all rows have is cut like any other; identical rows
are numbered and can be cut too. The place of a cut is found without moving rows: a histogram of bytes over at most
BUCKETS ranges per node, then over the range that holds the cut, until few rows are left. All nodes of a level are
worked off together; the driver sees BUCKETS sums and LAST rows a node, and a node a row of literals in the end.

Only metadata are shuffled (once, to number identical rows, and once for slots); texts are read once for size and crc32.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from schemagate.llm.common import keep

SHARDS = 16
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
#: Ranges of a histogram; rows of a range that are looked at one by one.
BUCKETS, LAST = 256, 256
#: Identical rows numbered in one task; rows of a run of slots.
COPIES, RUN = 16384, 512
_KEYS = 2**63 - 1


@dataclass
class Cut:
    """Where a node of `k` shards is cut: rows up to (value, key, copy) along `dimension` go to its first `left` shards."""

    k: int
    left: int
    dimension: int
    place: tuple[int, int, int]


def _code(documents: DataFrame, name: str) -> Column:
    """A whole number in the order of the column's values; text by its first seven bytes; null below all text."""
    if isinstance(documents.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType)):
        number = F.col(name).cast("bigint")
    else:
        head = F.rpad(F.substring(F.hex(F.col(name).cast("string")), 1, 14), 14, "0")
        number = F.conv(head, 16, 10).cast("bigint")
    return F.greatest(F.lit(-(2**61)), F.least(F.lit(2**61), F.coalesce(number, F.lit(-1))))


def metadata(documents: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """A row per document: doc_id, size, crc, v (codes of the dimensions), key, n (identical rows), copy (number among these)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.array(*(_code(documents, d) for d in dimensions)).alias("v"),
    )
    groups = rows.groupBy("doc_id", "size", "crc", "v").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("key", F.xxhash64("doc_id", "size", "crc", "v").bitwiseAND(F.lit(_KEYS)))
    runs = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint")))).repartition("key", "at")
    copy = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + COPIES, F.col("n")) - 1))
    return runs.select("doc_id", "size", "crc", "v", "key", "n", copy.alias("copy"))


def _pick(values: dict[int, int | bool], size: int, node: Column, default: int | bool = 0) -> Column:
    """The value of a node, from a literal array."""
    return F.element_at(F.lit([values.get(i, default) for i in range(size)]), node + 1)


def cut_rows(rows: DataFrame, level: dict[int, Cut], shards: int) -> DataFrame:
    """Rows (v, key, copy, node) with `node`, the first shard of their node, after the cuts of one level."""
    get = lambda f: _pick({s: f(c) for s, c in level.items()}, shards, F.col("node"))
    value, key = F.element_at("v", (get(lambda c: c.dimension) + 1).cast("int")), F.col("key")
    at_value, at_key, at_copy = (get(lambda c, k=k: c.place[k]) for k in range(3))
    behind = (value > at_value) | ((value == at_value) & ((key > at_key) | ((key == at_key) & (F.col("copy") > at_copy))))
    return rows.withColumn("node", F.when(behind, F.col("node") + get(lambda c: c.left)).otherwise(F.col("node")).cast("int"))


@dataclass
class _Search:
    """Search for a cut: a range of values, then of keys of one value, then of copies of one key."""

    goal: float
    dimension: int
    phase: int
    low: int
    high: int
    before: int = 0
    value: int = 0
    key: int = 0

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - BUCKETS.bit_length() + 1)

    def narrow(self, buckets: list[tuple[int, int, int]]) -> bool:
        """Go to the bucket of (number, bytes, rows) that holds the goal; whether its rows are few."""
        for number, size, n in sorted(buckets):
            if self.before + size >= self.goal:
                break
            self.before += size
        else:  # the goal is behind the last row, by rounding
            self.before -= size
        width, single = 1 << self.shift, self.shift == 0
        self.low = self.low + number * width
        self.high = min(self.high, self.low + width - 1)
        if n > LAST and single and self.phase < 2:
            if self.phase == 0:
                self.value = self.low
            else:
                self.key = self.low
            self.phase, self.low, self.high = self.phase + 1, 0, _KEYS
        return n <= LAST

    def settle(self, rows: list[tuple[int, int, int, int]]) -> tuple[int, int, int]:
        """The last of (value, key, copy, size) to go left; what is nearer to the goal of the two places around it."""
        rows, at = sorted(rows), self.before
        last = (rows[0][0], rows[0][1], rows[0][2] - 1)
        for *place, size in rows:
            if at + size / 2 > self.goal:
                break
            at, last = at + size, tuple(place)
        return last


def _searched(rows: DataFrame, active: dict[int, _Search], shards: int) -> DataFrame:
    """Rows in the ranges of active searches, with their coordinate in it."""
    get = lambda f: _pick({s: f(x) for s, x in active.items()}, shards, F.col("node"))
    value = F.element_at("v", (get(lambda x: x.dimension) + 1).cast("int"))
    phase = get(lambda x: x.phase)
    rows = rows.where(_pick({s: True for s in active}, shards, F.col("node"), False)).withColumns({"value": value, "phase": phase})
    place = F.when(F.col("phase") == 0, F.col("value")).when(F.col("phase") == 1, F.col("key")).otherwise(F.col("copy"))
    same = ((F.col("phase") == 0) | (F.col("value") == get(lambda x: x.value))) & ((F.col("phase") < 2) | (F.col("key") == get(lambda x: x.key)))
    low = get(lambda x: x.low)
    rows = rows.withColumn("place", place).where(same & F.col("place").between(low, get(lambda x: x.high)))
    return rows.withColumn("bucket", F.call_function("shiftright", F.col("place") - low, get(lambda x: x.shift).cast("int")))


def _level(rows: DataFrame, nodes: dict[int, int], whole: Row, shards: int, dimensions: int) -> dict[int, Cut]:
    """The cuts of all nodes (first shard: shards) of one level."""
    ends = [f(F.col("v")[d]).alias(f"{name}{d}") for d in range(dimensions) for name, f in (("low", F.min), ("high", F.max))]
    stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
    searches: dict[int, _Search] = {}
    for start, r in stats.items():
        if (k := nodes[start]) > 1:
            width = [(r[f"high{d}"] - r[f"low{d}"]) / max(1, whole[f"high{d}"] - whole[f"low{d}"]) for d in range(dimensions)]
            d = width.index(max(width))
            searches[start] = _Search(r["size"] * (k // 2) / k, d, 0, r[f"low{d}"], r[f"high{d}"])
    going = dict(searches)
    while going:
        found: dict[int, list] = {s: [] for s in going}
        for r in _searched(rows, going, shards).groupBy("node", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
            found[r.node].append((r.bucket, r["size"], r.n))
        going = {s: x for s, x in going.items() if not x.narrow(found[s])}
    left: dict[int, list] = {s: [] for s in searches}
    if searches:
        for r in _searched(rows, searches, shards).select("node", "value", "key", "copy", "size").collect():  # LAST rows a node
            left[r.node].append((r.value, r.key, r.copy, r["size"]))
    none = (0, 0, 0)  # of a node without rows
    return {s: Cut(k, k // 2, searches[s].dimension if s in searches else 0, searches[s].settle(left[s]) if s in searches else none) for s, k in nodes.items() if k > 1}


def kd_nodes(meta: DataFrame, shards: int, dimensions: int) -> DataFrame:
    """Metadata with `node`, the shard of each row: log2(shards) levels of about 3 + log(rows)/log(BUCKETS) small jobs.

    The rows are written again at each level; what a level decided is never computed twice.
    """
    rows, nodes = meta.withColumn("node", F.lit(0)), {0: shards}
    ends = [f(F.col("v")[d]).alias(f"{name}{d}") for d in range(dimensions) for name, f in (("low", F.min), ("high", F.max))]
    whole = meta.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    while whole.n and any(k > 1 for k in nodes.values()):
        level = _level(rows, nodes, whole, shards, dimensions)
        rows = keep(cut_rows(rows, level, shards), "shard-level")
        nodes = {p: k for s, c in level.items() for p, k in ((s, c.left), (s + c.left, c.k - c.left))} | {s: k for s, k in nodes.items() if k == 1}
    return rows


def slotted(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """Rows (shard, key, copy, n) with slot, gapless from 0 in each shard.

    Rows are numbered in runs of hash keys, about RUN rows each, behind the rows of the runs before; identical rows
    in large numbers are runs of their own.
    """
    bits = min(20, max(0, math.ceil(math.log2(max(1, count / shards / RUN)))))
    many = F.col("n") > COPIES
    run = F.struct(many.alias("many"), F.when(many, F.col("key")).otherwise(F.shiftright("key", 63 - bits)).alias("a"), F.when(many, F.floor(F.col("copy") / COPIES)).otherwise(0).alias("b"))
    rows = rows.withColumns({"run": run})
    sizes = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("in_run"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(sizes.select("shard", "run", F.coalesce(F.sum("in_run").over(before), F.lit(0)).alias("start")), "shard-runs")
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "copy"))
    return rows.join(starts, ["shard", "run"]).withColumn("slot", F.col("start") + place - 1)


def shard_documents(documents: DataFrame, *, shards: int = SHARDS, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of (doc_id, text and the dimensions).

    Size is the bytes of the text plus 1. With `target_bytes`, there are as many shards as leaves of that many bytes need.
    Cuts are where bytes are nearest to equal, so two shards differ by about the largest documents at their cuts; fewer
    documents than shards leave some empty. Null text: no bytes, crc32 0. Null dimensions sort below all text.
    Identical rows are kept and may lie in different shards. No rows: no rows. Other columns are not read.
    """
    meta = keep(metadata(documents.select("doc_id", "text", *(d for d in dimensions if d != "doc_id")), dimensions), "shard-rows")
    count, size = meta.agg(F.count(F.lit(1)), F.sum("size")).first()
    if target_bytes:
        shards = max(1, math.ceil((size or 0) / target_bytes))
    rows = kd_nodes(meta, shards, len(dimensions)).withColumnRenamed("node", "shard")
    return slotted(rows, shards, count).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")
