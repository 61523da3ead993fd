"""Plans that hold when one key owns a large share of the rows.

A key is *hot* when it has more than ``hot_rows`` rows. There can be at most ``rows / hot_rows``
hot keys, which bounds every broadcast made here; rows of the other keys take the usual shuffle.
No plan depends on task-local ids or random salts, so a re-run task puts its rows where they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan, None where the session does not expose it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:
        return None


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; counted with map-side combine."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).drop("__n")


def lookup_join(
    facts: DataFrame, dim: DataFrame, on: str, how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join facts to a table with unique keys.

    The table is broadcast when its estimated size fits. Else both sides are shuffled, and the
    adaptive skew join cuts the partition of a hot key into several tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    return facts.join(F.broadcast(dim) if fits_broadcast(dim, broadcast_bytes) else dim, on, how)


def split_join(facts: DataFrame, dim: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of a plain scan to a table with unique keys, too large to broadcast.

    Rows of hot keys meet the broadcast rows of those keys and are not shuffled at all. The facts
    are read three times, so this is for scans, not for the results of other joins.
    """
    keyed = facts.filter(F.col(on).isNotNull())
    hot = F.broadcast(hot_keys(keyed, [on], hot_rows))
    hot_dim = F.broadcast(dim.join(hot, on, "left_semi"))
    return keyed.join(hot_dim, on).unionByName(keyed.join(hot, on, "left_anti").join(dim, on))


def number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    chunk: Sequence[Column | str],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``.

    ``chunk`` are coarse steps of the ordering, columns or SQL expressions without nulls: rows of
    an earlier chunk come before those of a later one. Small groups are numbered by one window; hot groups are numbered chunk by chunk,
    each chunk starting after the row counts of the chunks before it.
    """
    hot = hot_keys(df, group, hot_rows)
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), list(group), "left")
    return _number(marked, group, order, chunk, name, F.col("__hot")).drop("__hot")


def number_hot(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], chunk: Sequence[Column | str], name: str
) -> DataFrame:
    """Like :func:`number_within` for rows whose groups are all known to be hot."""
    return _number(df, group, order, chunk, name, F.lit(True))


def _number(df, group, order, chunk, name, hot: Column) -> DataFrame:
    group = list(group)
    steps = [f"__step{i}" for i in range(len(chunk))]
    chunk = [F.expr(c) if isinstance(c, str) else c for c in chunk]
    tagged = df.withColumns({s: F.when(hot, c) for s, c in zip(steps, chunk)})
    before = Window.partitionBy(*group).orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.filter(hot)
        .groupBy(*group, *steps)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(*group, *steps, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    local = F.row_number().over(Window.partitionBy(*group, *steps).orderBy(*order))
    joined = tagged.withColumn("__local", local).join(offsets, [*group, *steps], "left")
    position = F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))
    return joined.withColumn(name, position.cast("bigint")).drop("__local", "__before", *steps)


def digest(*columns: Column) -> Column:
    """32-byte stand-in for wide values: equal exactly when all columns are, nulls included."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def flag_repeated(df: DataFrame, column: str, flag: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``flag``: whether the non-null value of ``column`` occurs more than once.

    Only digests of the values are counted and compared, so long texts are never shuffled as keys.
    Rows of hot values are settled by a broadcast and do not meet again in one task.
    """
    keyed = df.withColumn("__key", F.when(F.col(column).isNotNull(), digest(F.col(column))))
    repeated = (
        keyed.filter(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
    )
    hot = repeated.filter(F.col("__n") > hot_rows).select("__key", F.lit(True).alias("__is_hot"))
    cold = repeated.filter(F.col("__n") <= hot_rows).select(
        F.col("__key").alias("__probe"), F.lit(True).alias("__is_cold")
    )
    tagged = keyed.join(F.broadcast(hot), "__key", "left")
    # Rows already settled probe with a digest of their own: it matches nothing and spreads them out.
    settled = F.col("__is_hot") | F.col("__key").isNull()
    own = F.unhex(F.sha2(F.concat(F.lit("!"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in _identity(df, column)]))), 256))
    probe = F.when(F.coalesce(settled, F.lit(False)), own).otherwise(F.col("__key"))
    joined = tagged.withColumn("__probe", probe).join(cold, "__probe", "left")
    repeated_here = F.coalesce(F.col("__is_hot"), F.col("__is_cold"), F.lit(False))
    return joined.withColumn(flag, repeated_here).drop("__key", "__probe", "__is_hot", "__is_cold")


def _identity(df: DataFrame, column: str) -> list[str]:
    others = [c for c in df.columns if c != column]
    return others or [column]
