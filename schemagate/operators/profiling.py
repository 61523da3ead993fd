"""Profiling and quality metrics, each from one pass over the table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from schemagate.plans.skew import digest


def _stacked(one: DataFrame, structs: list[str]) -> DataFrame:
    """Turn a one-row table of structs into one row per struct."""
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, null and non-null count of every column."""
    aggregates = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("data_type"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"),
            F.count(F.col(f"`{c}`")).alias("non_null_count"),
        ).alias(f"_{i}")
        for i, (c, t) in enumerate(df.dtypes)
    ]
    one = df.agg(*aggregates)
    return _stacked(one, one.columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation (two values at least), minimum and maximum."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    aggregates = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("double")
        aggregates.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(f"_{i}")
        )
    one = df.agg(*aggregates)
    return _stacked(one, one.columns)


def _null_cells(df: DataFrame) -> Column:
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns[1:]), F.col(f"`{df.columns[0]}`").isNull().cast("int"))


def completeness(df: DataFrame) -> DataFrame:
    """Cell counts and the share of cells that hold a value."""
    width = len(df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(_null_cells(df)), F.lit(0)).cast("bigint").alias("null_cells"),
    )
    total = F.col("row_count") * width
    filled = F.when(total > 0, (total - F.col("null_cells")) / total).otherwise(F.lit(0.0))
    return one.select(
        "row_count",
        F.lit(width).alias("column_count"),
        total.cast("bigint").alias("total_cells"),
        "null_cells",
        filled.alias("completeness"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of copies beyond the first of each row; nulls count as equal.

    Rows are compared by digest, counted with map-side combine: any number of copies of one row
    reaches the reducer as one count per task.
    """
    counted = df.groupBy(digest(*[F.col(f"`{c}`") for c in df.columns]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def distinct_check(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Non-null and distinct count of each column, and whether its values are all different.

    One aggregate over (column, digest) pairs; no value is ever gathered whole.
    """
    columns = list(columns)
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), digest(F.col(c))).alias("k")) for c in columns])
        ).alias("p")
    ).select("p.*")
    per_value = pairs.filter(F.col("k").isNotNull()).groupBy("column", "k").agg(F.count(F.lit(1)).alias("n"))
    found = per_value.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("non_null"), F.count(F.lit(1)).alias("distinct_values")
    )
    return found.withColumn("all_distinct", F.col("non_null") == F.col("distinct_values"))


def quality_metrics(source: DataFrame, result: DataFrame, threshold: float = 0.8) -> DataFrame:
    """How much of the input is left in the output, and the verdict."""
    before, after = completeness(source), completeness(result)
    joined = before.select(
        F.col("row_count").alias("input_rows"),
        F.col("column_count").alias("input_columns"),
        F.col("completeness").alias("input_completeness"),
        F.lit(1).alias("k"),
    ).join(
        after.select(
            F.col("row_count").alias("output_rows"),
            F.col("column_count").alias("output_columns"),
            F.col("completeness").alias("output_completeness"),
            F.lit(1).alias("k"),
        ),
        "k",
    )
    retention = F.when(F.col("input_rows") > 0, F.col("output_rows") / F.col("input_rows")).otherwise(F.lit(0.0))
    mapping = F.when(F.col("input_columns") > 0, F.col("output_columns") / F.col("input_columns")).otherwise(F.lit(0.0))
    overall = (F.col("output_completeness") + F.col("row_retention_rate")) / 2
    return (
        joined.withColumn("row_retention_rate", retention)
        .withColumn("column_mapping_rate", mapping)
        .withColumn("completeness", overall)
        .withColumn("validation_status", verdict(F.col("completeness"), threshold))
        .drop("k")
    )


def verdict(score: Column, threshold: float = 0.8) -> Column:
    return F.when(score > threshold, "passed").otherwise("warning")


def budget_rollup(lines: DataFrame, levels: list[str]) -> DataFrame:
    """Planned, executed and remaining totals over every prefix of ``levels``."""
    return lines.rollup(*levels).agg(
        F.sum("planned").alias("planned_total"),
        F.sum("executed").alias("executed_total"),
        F.sum(F.col("planned") - F.col("executed")).alias("remaining_total"),
        F.count_if(F.col("status") == "active").alias("active_lines"),
        F.count(F.lit(1)).alias("line_count"),
        F.grouping_id().alias("level"),
    )
