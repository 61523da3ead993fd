"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget.

Every document gets a random key from its id. Sizes are summed per source and key range (two hash digits of
two places each), prefix sums over those ranges find the range in which a source's budget ends, and only the
documents of that one range are sorted to find the document in which it ends. All other documents compare
their key with the cut. The text is read once for its size, never shuffled; a hot source spreads over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemagate.llm.common import WORD, join_same, keep

WEIGHTS = (5, 2, 1)
CEILING = 3


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """One row per source of (source, source_size): its target, epochs and rest, as many words in all as there are.

    A source's share goes by weight but stops at `ceiling` times its size; what is above goes to the others by
    weight until none is above. That is a water level: sources ordered by ceiling over weight are full up to the
    first whose share of the remainder fits, which is the highest level that fits at all. The windows run over one row per source.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    weighted = weighted.withColumn("most", F.col("source_size") * ceiling)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("place"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighted.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    targets = levels.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    return targets.select("source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Targets with the place of the cut: its range (d1, d2), key and size, the rows tied there and the words each gives."""
    ranges = keep(sized.groupBy("source", "d1", "d2").agg(F.sum("size").alias("words")), "mix-ranges")
    first = ranges.groupBy("source", "d1").agg(F.sum("words").alias("words1"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("start1", F.coalesce(F.sum("words1").over(before(Window.partitionBy("source").orderBy("d1"))), F.lit(0)))
    targets = keep(source_targets(first.groupBy("source").agg(F.sum("words1").alias("source_size")), weights, ceiling), "mix-targets")
    digit = join_same(first, targets, ["source"]).where((F.col("rest") >= F.col("start1")) & (F.col("rest") < F.col("start1") + F.col("words1")))
    inner = join_same(ranges, digit.select("source", "d1", "start1", "rest"), ["source", "d1"])
    inner = inner.withColumn("start2", F.col("start1") + F.coalesce(F.sum("words").over(before(Window.partitionBy("source", "d1").orderBy("d2"))), F.lit(0)))
    place = inner.where((F.col("rest") >= F.col("start2")) & (F.col("rest") < F.col("start2") + F.col("words"))).select("source", "d1", "d2", "start2", "rest")
    near = join_same(sized, keep(place, "mix-place"), ["source", "d1", "d2"])
    ties = near.groupBy("source", "key", "size", "start2", "rest").agg(F.count(F.lit(1)).alias("tied"))
    total = F.col("size") * F.col("tied")
    start = F.col("start2") + F.coalesce(F.sum(total).over(before(Window.partitionBy("source").orderBy("key", "size"))), F.lit(0))
    cut = ties.withColumn("start", start).where((F.col("rest") >= F.col("start")) & (F.col("rest") < F.col("start") + total))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("start")) / F.col("tied")).alias("cut_words"))
    return keep(join_same(targets, cut, ["source"], "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words"), "mix-cuts")


def _sized(documents: DataFrame) -> DataFrame:
    sized = documents.select("doc_id", "source", _size(F.col("text")).alias("size"), _key(F.col("doc_id")).alias("key"))
    return sized.withColumns({"d1": F.substring("key", 1, 2), "d2": F.substring("key", 3, 2)})


def _part(key: Column, size: Column) -> Column:
    """Words that the last, partial epoch takes of a document; what comes before a missing cut is nothing."""
    at = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (size < F.col("cut_size")))
    return F.when(at, size).when((key == F.col("cut_key")) & (size == F.col("cut_size")), F.col("cut_words")).otherwise(F.lit(0)).cast("long")


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of (doc_id, text, source).

    Null text: size 0, takes nothing. Null source: a source of its own, last in order. Rows that share id and size
    at the cut share its words evenly (rounded down). No rows: no rows. Other columns are not read.
    """
    sized = keep(_sized(documents.select("doc_id", "text", "source")), "mix-sized")
    cuts = source_cuts(sized, weights, ceiling)
    joined = join_same(sized, cuts, ["source"])
    taken = F.col("epochs") * F.col("size") + _part(F.col("key"), F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The mix itself, with the columns of `documents`: a row per copy of a document, the one at the cut shortened.

    The shortened copy is its first words joined by single spaces; its n_chars, where there is one, is counted anew.
    All other columns are passed on as they are, whatever they are called.
    """
    sized = keep(_sized(documents.select("doc_id", "text", "source")), "mix-sized")
    cuts = source_cuts(sized, weights, ceiling).withColumnRenamed("source", "of")
    # the document's own columns stay in a struct, whatever they are called
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), _size(F.col("text")).alias("size"), _key(F.col("doc_id")).alias("key"))
    rows = rows.join(cuts.select("of", "epochs", "cut_key", "cut_size", "cut_words"), rows["doc"]["source"].eqNullSafe(F.col("of")))
    rows = rows.withColumn("part", _part(F.col("key"), F.col("size")))
    whole = F.col("epochs") + (F.col("part") == F.col("size")).cast("long")
    whole = F.when(F.col("size") > 0, whole).otherwise(0)
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("doc", F.explode(copies).alias("words"))
    kept = F.concat_ws(" ", F.slice(F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), 1), F.lit(1), F.greatest(F.col("words"), F.lit(1)).cast("int")))
    own = {"text": F.when(F.col("words") > 0, kept).otherwise(F.col("doc.text"))}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.when(F.col("words") > 0, F.char_length(kept).cast("long")).otherwise(F.col("doc.n_chars"))
    return rows.select(*(own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
