"""Merkle manifest of a dataset by time-forward processing.

Every node has a label (tree, level, position) and sends its digest forward to the label of its parent. The queue
that hands out these messages in order of label is external: Spark's sorted shuffle brings the nodes of BLOCK
consecutive places of a tree together in order, a small heap works off the levels inside the block, and the digest of
the block's top node is the one message to the next round. So a round lifts all trees by LEVELS levels and leaves
1/BLOCK of the nodes; two rounds cover 262,144 leaves of a tree, four 68 thousand million.

A sweep in reversed order then delivers proofs: the top of each block gets a message with the siblings on its way to
the root (its proof suffix), sorted before the block's own nodes; each node puts its siblings before its parent's suffix.
Only digests are shuffled. A block has at most BLOCK nodes, whatever the data, so no group grows with a hot key.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemagate.llm.common import keep

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Steps from a node to the root: siblings before it and behind it, from its own level up.
WAY = "before array<string>, after array<string>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered, row of every row of (doc_id, source, lang, n_chars, text).

    `tree` is the language, after "=", so that a missing one ("") comes first. `tampered` is the leaf with the text's
    A-Z lower-cased where 3 divides the crc32 of the id, else the leaf.
    """
    head, text = [_field(F.col(c)) for c in FIELDS[:-1]], F.col("text")
    leaf = F.sha2(F.concat(*head, _field(text)), 256)
    lowered = F.sha2(F.concat(*head, _field(F.translate(text, UPPER, LOWER))), 256)
    return documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), "doc_id", leaf.alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).otherwise(leaf).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with i, their place in their tree by `order`, and m, the rows of the tree.

    The sort is split by ranges; each task numbers its own rows, and the numbers of rows before them (one per task
    and tree) are added up. The last column of `order` tells equal rows apart, so a run of them is split like any other.
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = []
            for tree in batch["tree"].to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                own.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], [*batch.schema.names, "part", "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    numbered = keep(ordered.mapInArrow(number, f"{kinds}, part int, at bigint"), "merkle-places")
    sizes = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("m"))
    joined = numbered.join(keep(starts, "merkle-starts"), ["tree", "part"])
    return joined.select(*rows.columns, (F.col("start") + F.col("at")).alias("i"), "m")


def levels_left(m: int) -> int:
    """Levels that a block of a tree of m nodes goes up: until one node is left, at most LEVELS."""
    n = 0
    while m > 1 and n < LEVELS:
        m, n = -(-m // FANOUT), n + 1
    return n


def block_nodes(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of a block's nodes by level; a heap ordered by label hands each node its children's digests."""
    nodes: list[list[str]] = [digests] + [[] for _ in range(levels)]
    queue = [(1, i // FANOUT, i, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        own = digest("".join(children))
        nodes[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FANOUT, place, own))
    return nodes


def block_ways(nodes: list[list[str]], before: list[str], after: list[str]) -> list[tuple[list[str], list[str]]]:
    """Siblings before and behind, up to the root, of each lowest node of a block; given those of its top node."""
    ways = [(before, after)]
    for own in nodes[-2::-1]:
        down = []
        for i in range(len(own)):
            start = i // FANOUT * FANOUT
            up = ways[i // FANOUT]
            down.append((["".join(own[start:i]), *up[0]], ["".join(own[i + 1 : start + FANOUT]), *up[1]]))
        ways = down
    return ways


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (tree, block) at a time from rows in that order."""
    held, label = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != label:
                if held:
                    yield held
                held, label = [], (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")


def _forward(nodes: DataFrame) -> DataFrame:
    """(tree, m, i, digest) of the top nodes of all blocks of such nodes."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            levels, m = levels_left(rows[0]["m"]), rows[0]["m"]
            top = block_nodes([r["digest"] for r in rows], levels)[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": rows[0]["tree"], "m": -(-m // FANOUT**levels), "i": rows[0]["block"], "digest": top}], kinds)

    kinds = pa.schema([("tree", pa.string()), ("m", pa.int64()), ("i", pa.int64()), ("digest", pa.string())])
    labelled = nodes.select("tree", F.expr(f"i div {BLOCK}").alias("block"), "i", "m", "digest")
    return _by_block(labelled).mapInArrow(sweep, "tree string, m bigint, i bigint, digest string")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, m, i, digest) from the lowest up to the one in which every tree has one node."""
    rounds, most = [nodes], nodes.agg(F.max("m")).first()[0] or 0
    while most > 1:
        rounds.append(keep(_forward(rounds[-1]), "merkle-nodes"))
        most = -(-most // BLOCK)
    return rounds


def _delivered(nodes: DataFrame, messages: DataFrame, finish: bool) -> DataFrame:
    """Ways of the nodes of a round, from messages (tree, i, way) to the top nodes of its blocks.

    With `finish`, nodes are leaves (doc_id, tampered) and their proof and the root folded from `tampered` come out instead.
    """
    extra = ["doc_id", "tampered"] if finish else [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("tampered")]
    way = [F.lit(None).cast(t).alias(c) for c, t in (("before", "array<string>"), ("after", "array<string>"), ("subroot", "string"), ("root", "string"))]
    own = nodes.select("tree", F.expr(f"i div {BLOCK}").alias("block"), "i", "m", "digest", *extra, *way)
    sent = messages.select(
        "tree", F.col("i").alias("block"), F.lit(-1).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("tampered"), "before", "after", "subroot", "root",
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, *rows in _blocks(batches):  # the message sorts first
            ways = block_ways(block_nodes([r["digest"] for r in rows], levels_left(rows[0]["m"])), top["before"], top["after"])
            same = {"subroot": top["subroot"], "root": top["root"]}
            if not finish:
                yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "i": r["i"], "before": b, "after": a} | same for r, (b, a) in zip(rows, ways, strict=True)], passed)
                continue
            out = []
            for r, (before, after) in zip(rows, ways, strict=True):
                folded = r["tampered"]
                for b, a in zip(before, after, strict=True):
                    folded = digest(b + folded + a)
                proof = digest("".join(b + a for b, a in zip(before, after, strict=True)))
                out.append({"doc_id": r["doc_id"], "leaf": r["digest"], "proof_sha256": proof, "folded_root": folded, "verified": folded == top["root"]} | same)
            yield pa.RecordBatch.from_pylist(out, final)

    texts = lambda *names: [(n, pa.string()) for n in names]
    passed = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), *texts("subroot", "root")])
    final = pa.schema([("doc_id", pa.int64()), *texts("leaf", "subroot", "root", "proof_sha256", "folded_root"), ("verified", pa.bool_())])
    columns = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" if finish else f"tree string, i bigint, {WAY}"
    return _by_block(own.unionByName(sent)).mapInArrow(sweep, columns)


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of (doc_id, source, lang, n_chars, text).

    Rows of a language ascend by doc_id, a null one first; rows of one doc_id by their leaf, and identical rows are
    leaves each, in any order. Null values are `-` in a leaf; a null language is a tree of its own, the first. A lone
    leaf is its tree's root, a lone tree's root is the root; the proof of a leaf without siblings is the digest of nothing.
    No rows: no rows. Other columns are not read.
    """
    rows = keep(leaves(documents.select(*FIELDS)), "merkle-leaves")
    low = keep(placed(rows.withColumn("digest", F.col("leaf")), ["doc_id", "leaf", "row"]), "merkle-ordered")
    rounds = grown(low.select("tree", "m", "i", "digest"))
    subroots = placed(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])  # one row a language
    subroots = keep(subroots, "merkle-subroots")
    upper = grown(subroots.select("tree", "m", "i", "digest"))

    none = F.array().cast("array<string>")
    ways = upper[-1].select("tree", "i", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in upper[-2::-1]:
        ways = keep(_delivered(nodes, ways, False), "merkle-ways")
    ways = subroots.select("i", "name", "digest").join(ways.drop("subroot", "tree"), "i")
    ways = keep(ways.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("i"), "before", "after", F.col("digest").alias("subroot"), "root"), "merkle-ways")
    for nodes in rounds[-2:0:-1]:
        ways = keep(_delivered(nodes, ways, False), "merkle-ways")
    return _delivered(low, ways, True)
