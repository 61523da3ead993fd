"""Near-duplicates by SetSketch: registers, banding, joint likelihood, exact verification.

A document's set of word shingles becomes m registers: each element sends a Poisson process of points, marked
with a random register, and a register keeps its smallest point h, truncated to 1 - floor(log_b h) in 16 bits.
Registers are mergeable (element-wise maximum) and agree with probability close to the Jaccard similarity. Equal
bands of registers propose pairs; the joint likelihood of (greater, less, equal) registers and the two known set
sizes drops pairs that are out of the question; what is left is settled on the full sets.

Buckets of two or more are kept once and worked off in two rounds, so that no group emits all its pairs: first every
member against the smallest of its bucket; then, in buckets that still span several components, members of different
components, in blocks of bounded size that are streamed one after the other. That is done twice: on registers alone,
in large blocks, to name the members that could have a partner, and for these, in smaller blocks, on full texts. What
is known of a node is joined to it once, before its places in buckets and blocks are spread out. A pair inside one
component needs no test, as only components are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import keep, mix64, slices, words_of
from schemagate.llm.graph import components, roots

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
#: Scale that keeps registers of sets of 1 to about 10^20 elements within 16 bits.
RATE = 20.0
#: A pair is dropped unseen if the likelihood of the threshold is below that of the best estimate by this exponent.
UNLIKELY = 14.0
#: Members of a block that meets on registers; of one that meets on texts, and their shingles; pairs weighed at once.
WIDE_BLOCK, BLOCK, BLOCK_SHINGLES, PAIRS = 2048, 512, 500_000, 20_000


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers of several sets at once, as uint16 (len(sets), m); those of an empty set are 0.

    Points of an element rise; as soon as one passes the largest register minimum of its set, the rest cannot
    matter and the element is done. That takes about m ln m points a set, whatever its size.
    """
    least = np.full((len(sets), m), np.inf)
    flat = least.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.zeros(len(element))
    step = 0
    while len(element):
        # the first points of all elements come one by one, later ones of the few left in runs
        for _ in range(1 if step < 4 else 16):
            step += 1
            bits = mix64(element + np.uint64((step * 0xD1342543DE82EF95) % 2**64))
            at = at - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / m
            place = ((mix64(bits ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, row * m + place, at)
        going = at < least.max(axis=1)[row]
        element, row, at = element[going], row[going], at[going]
    with np.errstate(divide="ignore"):
        registers = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.where(np.isinf(least), 0, np.clip(registers, 0, 65535)).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely Jaccard similarity of register pairs, and by how much the log-likelihood of `threshold` is below it."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        greater, less = p(u - v * j), p(v - u * j)
        return up * np.log(greater) + down * np.log(less) + same * np.log(np.clip(1 - greater - less, 1e-12, 1))

    low, high = np.zeros_like(top), top
    for _ in range(16):  # the likelihood has one peak
        third = (high - low) / 3
        left = score(low + third) < score(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    best = (low + high) / 2
    return best, score(best) - score(np.minimum(threshold, top))


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose set sizes and registers allow the similarity."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    j, behind = likely_similarity(a[fits], b[fits], n_a[fits].astype(float), n_b[fits].astype(float), percent / 100)
    fits[fits] = (j >= percent / 100) | (behind <= UNLIKELY)
    return fits


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of slices of their incidence matrix.

    Only elements that two sets hold matter; a slice has a bounded number of columns.
    """
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    use = times[element] > 1
    row, element = row[use], column[element[use]]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
        a, b = np.searchsorted(element, [low, low + 4096])
        slice_ = np.zeros((len(sets), 4096), np.float32)
        slice_[row[a:b], element[a:b] - low] = 1
        out += (slice_ @ slice_.T).astype(np.int64)
    return out


def _sketched(documents: DataFrame, width: int) -> DataFrame:
    """A row, with a number of its own, per row of (doc_id, tie, text); tie is a hash of the text."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1000):
            sets = [shingle_set(words_of(t.as_py()), width) for t in batch["text"]]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sets))), batch["doc_id"], batch["tie"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())],
                ["row", "doc_id", "tie", "n_shingles", "digest", "sketch"],
            )
            row += len(sets)

    return documents.mapInArrow(sketch, "row bigint, doc_id bigint, tie bigint, n_shingles bigint, digest binary, sketch binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs, tested on the full sets of `texts` (node, text)."""
    pairs = keep(pairs, "dup-pairs")
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "dup-wanted")
    texts = texts.join(wanted, "node", "left_semi")
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in slices(batches, 1000):
            a, b, links = [], [], zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text_a"], batch["text_b"], strict=True)
            for x, y, text_x, text_y in links:
                if x != last:
                    last, held = x, shingle_set(words_of(text_x.as_py()), width)
                other = shingle_set(words_of(text_y.as_py()), width)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * shared >= percent * (len(held) + len(other) - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keep(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(settle, "a bigint, b bigint"), "dup-links")


#: One meeting of two blocks (or of one with itself): its key, and what is held of each member.
MEETING = ["bucket", "i", "j"]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of one meeting after the other, from batches sorted by meeting."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch[k].to_numpy() for k in MEETING])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            if low < high:
                if held and tuple(key[:, low]) != last:
                    yield pa.concat_batches(held)
                    held = []
                last = tuple(key[:, low])
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


def _candidates(members: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a meeting whose labels differ, which no other band brings first, and whose registers allow the similarity."""
    i, j, band = members["i"][0].as_py(), members["j"][0].as_py(), members["bucket"][0].as_py() & 63
    node, label, n, block, centre = (members[k].to_numpy() for k in ("node", "label", "n_shingles", "block", "centre"))
    registers = _registers(members["sketch"])
    left, right = np.flatnonzero((block == i) & (node != centre)), np.flatnonzero((block == j) & (node != centre))
    bands, kept = registers.view([("", "<u2")] * ROWS).reshape(len(node), -1), [np.zeros((2, 0), np.int64)]
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        x = left[at : at + step, None]
        x, y = np.nonzero((label[x] != label[right]) & ((node[x] < node[right]) | (i != j)))
        a, b = left[at + x], right[y]
        first = np.argmax(bands[a] == bands[b], axis=1) == band
        a, b = a[first], b[first]
        if len(a):
            good = possible(registers[a], registers[b], n[a], n[b], percent)
            kept.append(np.stack([a[good], b[good]]))
    x, y = np.concatenate(kept, axis=1)
    return x, y


def spread(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of (node, ...) with what `table` holds of their node; the join makes one row a node, however many it has."""
    places = rows.groupBy("node").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "node"])).alias("places"))
    return places.join(table, "node").select(*table.columns, F.inline("places"))


def met(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members of buckets, a row per meeting of their block; `blocks` (bucket, blocks) are the buckets gone through."""
    rows = members.join(blocks.select("bucket", F.ceil("blocks").cast("int").alias("blocks")), "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "n_shingles", "centre", "block")


def near_duplicates(documents: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of (doc_id, text).

    Links join documents of similarity of at least `percent`; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have no shingles and link with nothing. Texts of fewer than `width` words are one shingle.
    Copies are one class from the start and never paired. Rows that share a doc_id are one document, linked by each
    of their texts: they have one component_id between them, but each its own n_shingles; a row without shingles has
    its doc_id. A null doc_id is its own component (null, not kept). Other columns are not read.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    done = keep(_sketched(docs, width), "dup-sketches")
    known = done.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # a class of equal sets is a node, numbered by one of its rows
    classes = keep(known.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "dup-classes")
    reps = known.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "tie", "n_shingles", "sketch")
    reps = keep(reps, "dup-reps")
    texts = docs.join(reps.select("node", "doc_id", "tie"), ["doc_id", "tie"]).select("node", "text")
    repeated = keep(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "dup-repeated")
    some_repeat = not repeated.isEmpty()
    if some_repeat:  # a row that stands there twice is one text
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    # the number of the band is in the lowest bits of the bucket
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.col("sketch").substr(k * (2 * ROWS) + 1, F.lit(2 * ROWS))).bitwiseAND(F.lit(~63)).bitwiseOR(k.cast("bigint")))
    bands = reps.select("node", F.explode(band).alias("bucket"))
    size = bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(bands.join(size, "bucket").select("bucket", "node", "centre", "n"), "dup-members")

    # round one: each member against the smallest of its bucket
    stars = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    one = reps.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = reps.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            good = possible(_registers(batch["s_a"]), _registers(batch["s_b"]), batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    fitting = stars.join(two, "b").join(one, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = _confirmed(fitting.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(weigh, "a bigint, b bigint"), texts, width, percent)
    if some_repeat:
        own = known.join(repeated, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "node").distinct()
        same = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node != a").select("a", F.col("node").alias("b"))
        links = keep(links.unionAll(same), "dup-links")
    part = keep(components(links), "dup-part")

    # round two: members of one bucket and different components, block against block
    labels = reps.join(part, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "n_shingles")
    labelled = keep(spread(members.where("n > 2").select("bucket", "node", "centre"), labels), "dup-labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), (F.count(F.lit(1)) / WIDE_BLOCK).alias("blocks")).where("low != high")
    sketch = reps.select("node", "sketch")

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(*MEETING).sortWithinPartitions(*MEETING)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members_ in _meetings(batches):
            some = np.unique(np.concatenate(_candidates(members_, percent)))
            if len(some):
                yield members_.select(["bucket", "node", "label", "n_shingles", "centre"]).take(pa.array(some))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members_ in _meetings(batches):
            x, y = _candidates(members_, percent)
            node, n = members_["node"].to_numpy(), members_["n_shingles"].to_numpy()
            shared = shared_counts([shingle_set(words_of(t.as_py()), width) for t in members_["text"]])
            common = shared[x, y]
            linked = 100 * common >= percent * (n[x] + n[y] - common)
            root = node[roots(len(node), x[linked], y[linked])]
            yield pa.RecordBatch.from_arrays([pa.array(root[root != node]), pa.array(node[root != node])], ["a", "b"])

    columns = "bucket bigint, node bigint, label bigint, n_shingles bigint, centre bigint"
    likely = keep(meet(spread(met(labelled, mixed), sketch)).mapInArrow(narrow, columns).distinct(), "dup-likely")
    blocks = likely.groupBy("bucket").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"))
    wanted = sketch.join(texts.join(likely.select("node").distinct(), "node", "left_semi"), "node")
    more = meet(spread(met(likely, blocks), wanted)).mapInArrow(cross, "a bigint, b bigint").distinct()
    part = keep(components(links.unionAll(more)), "dup-part")

    whole = keep(classes.join(part, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component")), "dup-whole")
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "component").select("digest", "component_id")
    out = done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
