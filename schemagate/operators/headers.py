"""Schema matching of many files at once.

Input is a table of headers, one row per column of a file: ``file_id``, ``position``, ``header``.
Targets come from a profile, so their number is small and fixed; they travel as a literal array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemagate.functions.headers import (
    BOOTSTRAP_SIMILARITY,
    MIN_SIMILARITY,
    header_row_score,
    looks_generic,
    normalize_header,
    similarity,
)
from schemagate.profiles import Profile

HEADER_SCAN_ROWS = 10


def distinct_headers(headers: DataFrame) -> DataFrame:
    """Each header text of a file once, at its first position."""
    return headers.groupBy("file_id", "header").agg(F.min("position").alias("position"))


def _targets(targets: Sequence[str]):
    return F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(i).alias("target_pos"), normalize_header(F.lit(t)).alias("norm"))
            for i, t in enumerate(targets)
        ]
    )


def header_pairs(headers: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Similarity of every header of a file to every target; rows grow with headers only."""
    normalized = distinct_headers(headers).withColumn("norm", normalize_header(F.col("header")))
    paired = normalized.withColumn("t", F.explode(_targets(targets)))
    return paired.select(
        "file_id", "header", "position", "t.target", "t.target_pos",
        similarity(F.col("norm"), F.col("t.norm")).alias("similarity"),
    )


def greedy_matches(
    headers: DataFrame,
    targets: Sequence[str],
    min_similarity: float = MIN_SIMILARITY,
    settled: DataFrame | None = None,
) -> DataFrame:
    """One-to-one matches per file: targets in order of their best score take their best free header.

    Headers and targets of matches that are ``settled`` already are left out.

    Earlier targets can take at most ``len(targets) - 1`` headers, so the best ``len(targets)``
    headers of a target decide its match: what a file brings to one row is bounded by the profile,
    however many headers it has.
    """
    per_target = Window.partitionBy("file_id", "target")
    pairs = header_pairs(headers, targets).filter(F.col("similarity") >= min_similarity)
    if settled is not None:
        for side in ("target", "header"):
            pairs = pairs.join(settled.select("file_id", side), ["file_id", side], "left_anti")
    ranked = (
        pairs
        .withColumn("rank", F.row_number().over(per_target.orderBy(F.desc("similarity"), "position")))
        .filter(F.col("rank") <= len(targets))
        .withColumn("best", F.max("similarity").over(per_target))
    )
    candidate = F.struct(
        (-F.col("best")).alias("by_best"), "target_pos", "rank", "target", "header", "position", "similarity"
    )
    files = ranked.groupBy("file_id").agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))
    empty = F.expr("slice(candidates, 1, 0)")

    def take(chosen, x):
        taken = F.exists(chosen, lambda m: (m["target"] == x["target"]) | (m["header"] == x["header"]))
        return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(x)))

    chosen = files.select("file_id", F.explode(F.aggregate("candidates", empty, take)).alias("m"))
    return chosen.select("file_id", "m.target", "m.header", "m.position", "m.similarity")


def alias_matches(headers: DataFrame, profile: Profile) -> DataFrame:
    """First listed alias of each target that a file has, ignoring case."""
    spark = headers.sparkSession
    aliases = spark.createDataFrame(profile.aliases(), "target string, alias string, rank int")
    keyed = headers.withColumn("alias", F.lower("header"))
    # The alias table is as large as the profile: a fixed few hundred rows at most.
    found = keyed.join(F.broadcast(aliases), "alias")
    # Of headers that differ in case only, the last one counts.
    order = F.struct(F.col("rank"), (-F.col("position")).alias("last"))
    return found.groupBy("file_id", "target").agg(F.min_by("header", order).alias("header"))


def match_files(headers: DataFrame, profile: Profile, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Matches of every file (file_id, target, header): listed aliases first, similar names for the rest.

    A header that is an alias of two targets goes to the first of them.
    """
    rank = F.create_map(*[x for i, t in enumerate(profile.targets) for x in (F.lit(t), F.lit(i))])
    listed = (
        alias_matches(headers, profile)
        .groupBy("file_id", "header")
        .agg(F.min_by("target", F.element_at(rank, F.col("target"))).alias("target"))
        .select("file_id", "target", "header")
    )
    similar = greedy_matches(headers, profile.targets, min_similarity, listed)
    return listed.unionByName(similar.select("file_id", "target", "header"))


def bootstrap_profile(
    headers: DataFrame, targets: Sequence[str], min_similarity: float = BOOTSTRAP_SIMILARITY
) -> DataFrame:
    """Proposed aliases: per file and target all similar headers, or else the target's own name."""
    similar = header_pairs(headers, targets).filter(F.col("similarity") > min_similarity)
    found = similar.select("file_id", "target", F.col("header").alias("source"))
    missing = file_targets(headers, targets).join(
        found.select("file_id", "target").distinct(), ["file_id", "target"], "left_anti"
    )
    return found.unionByName(missing.withColumn("source", F.col("target")))


def file_targets(headers: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every target for every file."""
    return headers.select("file_id").distinct().withColumn("target", F.explode(F.array(*map(F.lit, targets))))


def unmatched_sources(headers: DataFrame, matches: DataFrame) -> DataFrame:
    return headers.join(matches.select("file_id", "header"), ["file_id", "header"], "left_anti")


def unmatched_targets(headers: DataFrame, targets: Sequence[str], matches: DataFrame) -> DataFrame:
    return file_targets(headers, targets).join(
        matches.select("file_id", "target"), ["file_id", "target"], "left_anti"
    )


def match_report(headers: DataFrame, targets: Sequence[str], matches: DataFrame) -> DataFrame:
    """Per file: header and match counts, and the share of targets matched."""
    files = headers.groupBy("file_id").agg(F.count(F.lit(1)).alias("headers"))
    matched = matches.groupBy("file_id").agg(F.count(F.lit(1)).alias("matched"))
    count = F.coalesce("matched", F.lit(0))
    return files.join(matched, "file_id", "left").select(
        "file_id", "headers", count.cast("bigint").alias("matched"),
        (len(targets) - count).cast("bigint").alias("unmatched_targets"),
        (count / max(len(targets), 1)).alias("confidence"),
    )


def detect_header_rows(rows: DataFrame, scan_rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """First best-scoring row among the first rows of each file (``file_id``, ``row_id``, ``cells``)."""
    scored = rows.filter(F.col("row_id") < scan_rows).withColumn("score", header_row_score(F.col("cells")))
    best = scored.groupBy("file_id").agg(F.max(F.struct("score", (-F.col("row_id")).alias("first"), "cells")).alias("b"))
    # Filtered last: a filter on the score before the aggregate would compute every score twice.
    return best.filter(F.col("b.score") > 0).select(
        "file_id", (-F.col("b.first")).alias("header_row"), F.col("b.score").alias("score"), F.col("b.cells").alias("headers")
    )


def locate_headers(rows: DataFrame, scan_rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Header row of each file: its first row that is there, or, if that says nothing, the best-looking of the next ones.

    ``scan_rows`` rows after the first are looked at. Row ids may start anywhere: blank lines have none.
    """
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("row_id"))
    top = rows.withColumn("place", place).filter(F.col("place") <= scan_rows + 1)
    first = top.filter(F.col("place") == 1).select("file_id", F.col("cells").alias("first_cells"), F.col("row_id").alias("first_row"))
    later = top.filter(F.col("place") > 1).withColumnRenamed("row_id", "at").withColumn("row_id", F.col("place") - 2)
    found = detect_header_rows(later, scan_rows).withColumnRenamed("header_row", "place")
    found = found.join(later.select("file_id", F.col("row_id").alias("place"), F.col("at").alias("header_row")), ["file_id", "place"])
    unnamed = F.forall("first_cells", lambda c: F.coalesce(c, F.lit("")).rlike(r"^(|Unnamed:.*|Column_.*|\d+)$"))
    use_found = unnamed & F.col("header_row").isNotNull()
    return first.join(found, "file_id", "left").select(
        "file_id",
        F.when(use_found, F.col("header_row")).otherwise(F.col("first_row")).cast("bigint").alias("header_row"),
        F.when(use_found, F.col("headers")).otherwise(F.col("first_cells")).alias("cells"),
    )


def header_table(spark: SparkSession, names: Sequence[str], file_id: str = "") -> DataFrame:
    """Header table of one file."""
    return spark.createDataFrame(
        [(file_id, i, n) for i, n in enumerate(names)], "file_id string, position int, header string"
    )


def map_columns(
    spark: SparkSession,
    names: Sequence[str],
    profile: Profile,
    min_similarity: float = MIN_SIMILARITY,
    use_aliases: bool = True,
) -> dict[str, tuple[str, float]]:
    """Target to (source, similarity) for one file: listed aliases first, similar names for the rest."""
    headers = header_table(spark, names)
    listed = match_files(headers, profile, min_similarity) if use_aliases else None
    if listed is None:
        found = greedy_matches(headers, profile.targets, min_similarity).select("target", "header", "similarity")
    else:
        score = similarity(normalize_header(F.col("header")), normalize_header(F.col("target")))
        aliases = {(t, a) for t, a, _ in profile.aliases()}
        found = listed.select("target", "header", score.alias("similarity"))
        return {
            r.target: (r.header, 1.0 if (r.target, r.header.lower()) in aliases else r.similarity) for r in found.collect()
        }
    return {r.target: (r.header, r.similarity) for r in found.collect()}


def column_mapping(matches: dict[str, tuple[str, float]]) -> dict[str, str]:
    """Source to target."""
    return {source: target for target, (source, _) in matches.items()}


def needs_header_detection(names: Sequence[str]) -> bool:
    return looks_generic(list(names))
