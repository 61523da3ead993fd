"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto several sets of orthonormal random directions; in each, shifted and quantised coordinates
become a key on a Hilbert curve. Spark range-partitions the keys of each curve, so a range of neighbouring keys is
one block; a query visits the blocks within a window of ranks around its own place on every curve, and the
candidates of all curves are merged and ranked by exact cosine.

Window and curves set recall. Independent directions without any structure are the hardest case: there a window has
to cover a fair share of the ranks, and the work is that of a stated query set against blocks of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemagate.llm.common import keep, slices
from schemagate.llm.vectors import units, usable

CURVES, DIRECTIONS, BITS = 8, 8, 5
#: Share of a curve's ranks that a query's window spans, and the rows it spans at least.
WINDOW, LEAST_ROWS = 0.16, 200
#: Rows of a block, and queries that meet it at once.
BLOCK, QUERIES = 4096, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of integer coordinates below 2^bits.

    From the highest bit down, each coordinate either inverts or exchanges the lower bits of the first one; a Gray
    decoding over all coordinates and bits follows, and the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(len(x)):
            high = (x[k] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> level & 1
    return key


def curve_keys(x: np.ndarray, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Keys (rows, curves) of unit vectors; every curve has its own directions and shift."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    base = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-curves * directions // dim))], axis=1)
    shifts = rng.random((curves, directions)) if curves else None
    keys = []
    for c in range(curves):
        y = x @ base[:, c * directions : (c + 1) * directions] * np.sqrt(dim)
        spread = 1 / (1 + np.exp(-1.702 * y))  # near to the normal distribution's: even cells
        keys.append(hilbert_keys(np.minimum((spread + shifts[c]) / 2 * (1 << bits), (1 << bits) - 1), bits))
    return np.stack(keys, axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, window: float = WINDOW, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of (vec_id, embedding) for each row of `queries`, itself left out.

    `queries` are rows of `vectors`. Equal queries are searched for once: a class of equal vectors is given its k + 1
    nearest ids, from which each of its queries takes the first k that are not its own. Ties go to the smaller vec_id. Null, zero and non-finite vectors and those with null components take no part, on
    either side; neither do null ids. Vectors of different length are not compared. Equal vectors are indexed once
    with their k + 1 smallest ids. No rows: no rows. Other columns are not read.
    """
    rows = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = rows(vectors).withColumn("place", order).where(F.col("place") <= k + 1)
    classes = classes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def place(batches):
        for batch in slices(batches, 4096):
            pdf = batch.to_pandas()
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                keys = curve_keys(units(part["embedding"]))
                for c in range(keys.shape[1]):
                    yield pa.RecordBatch.from_pandas(part.assign(curve=np.int32(c), dim=np.int32(dim), key=keys[:, c]), schema, preserve_index=False)

    schema = pa.schema([("curve", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("embedding", pa.list_(pa.float64()))])
    index = classes.mapInArrow(place, "curve int, dim int, key bigint, ids array<bigint>, embedding array<double>")
    index = keep(index.withColumn("rep", F.col("ids")[0]), "nn-index")
    total = index.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    ranged = index.repartitionByRange(max(CURVES, -(-total // block)), "curve", "dim", "key", "rep").withColumn("block", F.spark_partition_id())
    ranged = keep(ranged, "nn-ranges")
    sizes = ranged.groupBy("curve", "dim", "block").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("curve", "dim").orderBy("block")
    sizes = sizes.withColumn("end", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("curve", "dim")))
    blocks = keep(sizes.select("curve", "dim", "block", (F.col("end") - F.col("n")).alias("start"), "end", "all"), "nn-blocks")

    # a query's rank on every curve: the start of its block and the place of its key in it
    asked = rows(queries).select("embedding").distinct()
    within = F.row_number().over(Window.partitionBy("curve", "dim", "block").orderBy("key", "rep")) - 1
    ranks = ranged.withColumn("within", within).join(asked, "embedding").join(blocks, ["curve", "dim", "block"])
    ranks = ranks.select("curve", "dim", "rep", "embedding", (F.col("start") + F.col("within")).alias("at"), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("all") * window)).alias("span"))
    ranks = ranks.withColumns({"low": F.col("at") - F.col("span") / 2, "high": F.col("at") + F.col("span") / 2})
    spans = blocks.groupBy("curve", "dim").agg(F.sort_array(F.collect_list(F.struct("start", "end", "block"))).alias("blocks"))
    visits = ranks.join(spans, ["curve", "dim"]).select("curve", "dim", F.col("rep").alias("asker"), "embedding", F.explode(F.filter("blocks", lambda b: (b["end"] > F.col("low")) & (b["start"] <= F.col("high")))).alias("b"))
    visits = visits.select("curve", "dim", F.col("b.block").alias("block"), "asker", "embedding")
    visits = keep(visits, "nn-visits")
    chunks = keep(visits.groupBy("block", "curve", "dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")), "nn-chunks")
    asks = visits.join(chunks, ["block", "curve", "dim"]).select("block", "curve", "dim", F.pmod(F.xxhash64("asker"), F.col("chunks")).cast("int").alias("chunk"), "asker", F.lit(None).cast("array<bigint>").alias("ids"), "embedding")
    gives = ranged.join(chunks, ["block", "curve", "dim"]).select("block", "curve", "dim", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("bigint").alias("asker"), "ids", "embedding")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["ids"].isna().to_numpy()
        ask, give = pdf[is_query], pdf[~is_query]
        out = []
        y, ids = units(give["embedding"]), give["ids"].to_list()
        first = np.array([i[0] for i in ids])
        for at in range(0, len(ask), 512):
            part = ask.iloc[at : at + 512]
            scores = units(part["embedding"]) @ y.T
            # classes beyond the first k + 1 by (score, id) can't matter: each has an id of its own
            best = np.argpartition(-scores, min(k + 1, scores.shape[1] - 1), axis=1)[:, : k + 1] if scores.shape[1] > k + 1 else np.tile(np.arange(scores.shape[1]), (len(part), 1))
            for r, q in enumerate(part["asker"]):
                least = scores[r][best[r]].min()
                close = np.flatnonzero(scores[r] >= least - 1e-12)
                close = close[np.lexsort((first[close], -scores[r][close]))][: k + 1]
                found = sorted((-scores[r][c], i) for c in close for i in ids[c])[: k + 1]
                out += [(q, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["asker", "vec_id", "score"]).astype({"asker": "int64", "vec_id": "int64", "score": "float64"})

    found = asks.unionByName(gives).groupBy("block", "curve", "dim", "chunk").applyInPandas(rank, "asker bigint, vec_id bigint, score double")
    # one score per pair: curves compute it in different matrix products, so it is taken to a fixed precision for ties
    merged = found.groupBy("asker", "vec_id").agg(F.max("score").alias("score")).withColumn("order", -F.round("score", 12))
    place_ = F.row_number().over(Window.partitionBy("asker").orderBy("order", "vec_id"))
    near = merged.withColumn("place", place_).where(F.col("place") <= k + 1)
    near = keep(near.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("order", "vec_id", "score"))).alias("near")), "nn-found")

    # each query takes the list of its class
    classes = index.where("curve = 0").select(F.col("rep").alias("asker"), "embedding")
    own = rows(queries).select(F.col("vec_id").alias("query_id"), "embedding").join(classes, "embedding").select("query_id", "asker").join(near, "asker")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    own = own.select("query_id", F.posexplode(others).alias("at", "n"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
