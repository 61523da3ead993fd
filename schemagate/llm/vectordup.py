"""Near-duplicate vectors: int8 tile products with error bounds, exact cosine only where the bound leaves it open.

Vectors of one label are dealt to tiles of bounded size; every pair of tiles meets in one group. A unit vector x
is scale * q + e with q in int8; the norm of e is known, so |x.y - s_x s_y q_x.q_y| is at most
|e_x||s_y q_y| + |e_y||s_x q_x| + |e_x||e_y|. Integer products of a tile pair are one matrix product (exact in
float32 up to 1,040 dimensions, float64 beyond); only pairs whose upper bound reaches the threshold are computed in
double precision. A tile pair gives a link count and one edge of a spanning forest per vector, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import join_same, keep
from schemagate.llm.graph import components, roots
from schemagate.llm.vectors import units, usable

TILE = 2048
#: Pairs computed in double precision at once.
AT_ONCE = 65536
#: Rounding of the approximate side, far above that of sums of doubles.
SLACK = 1e-6


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of scale * code, norms of what the code leaves out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of x, row of y) of cosine >= threshold; y None: pairs within x, each once."""
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    qx, sx, nx, ex = quantised(x)
    qy, sy, ny, ey = (qx, sx, nx, ex) if y is None else quantised(y)
    product = (qx.astype(kind) @ qy.astype(kind).T) * sx[:, None] * sy
    product += ex[:, None] * ny + ey * nx[:, None] + ex[:, None] * ey + SLACK
    open_ = product >= threshold
    if y is None:
        open_, y = np.triu(open_, 1), x
    i, j = np.nonzero(open_)
    good = [(x[i[k : k + AT_ONCE]] * y[j[k : k + AT_ONCE]]).sum(axis=1) >= threshold for k in range(0, len(i), AT_ONCE)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label); vec_ids are taken to be unique.

    Only vectors of equal, non-null label and equal length are compared. Null, zero and non-finite vectors and those
    with null components link with nothing. Equal vectors of a label are one class, compared once and counted each.
    A null vec_id of a lone vector is not kept. No rows: no rows. Other columns are not read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = rows.where(usable() & F.col("label").isNotNull())
    classes = keep(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vec-classes")
    sized = classes.withColumn("dim", F.size("embedding"))
    counts = keep(sized.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "vec-tiles")
    dealt = join_same(sized, counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    pairs = dealt.select("label", "dim", "tile", "rep", "n", "embedding", F.explode(mates).alias("mates")).select("label", "dim", "mates.i", "mates.j", "tile", "rep", "n", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, n, rep = units(pdf["embedding"]), pdf["n"].to_numpy(), pdf["rep"].to_numpy()
        left, right = np.flatnonzero(pdf["tile"] == pdf["i"][0]), np.flatnonzero(pdf["tile"] == pdf["j"][0])
        a, b = tile_links(x[left], None if pdf["i"][0] == pdf["j"][0] else x[right], threshold)
        a, b = left[a], right[b]
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[roots(len(pdf), a, b)][some]})

    found = keep(pairs.groupBy("label", "dim", "i", "j").applyInPandas(compare, "rep bigint, links bigint, root bigint"), "vec-links")
    part = keep(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "vec-part")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.join(linked, "rep", "left").join(part, F.col("rep") == F.col("node"), "left")
    classes = classes.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
