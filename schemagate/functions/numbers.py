"""Numbers out of text: integers, decimals in several notations, money."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagate.functions.text import strip

# Guards the casts: they would take "1.0d", "inf" or "nan" for numbers.
NUMERIC_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Separators of the default notation.
THOUSAND_SEPARATORS = (" ", ",")
DECIMAL_SEPARATORS = (",", ".")

DECIMAL_TYPE = "decimal(20,6)"
MONEY_TYPE = "decimal(18,2)"


def numeric(c: Column, data_type: str = "double") -> Column:
    """Plain numeric text as ``data_type``, null for everything else."""
    # Casting only what matched: a failed cast costs far more than the match.
    return F.nullif(F.regexp_extract(strip(c), NUMERIC_PATTERN, 0), F.lit("")).try_cast(data_type)


def parse_integer(c: Column, thousand: Sequence[str] = THOUSAND_SEPARATORS) -> Column:
    """Drop thousand separators, then cut the fraction toward zero."""
    s = strip(c)
    for sep in filter(None, thousand):
        s = F.replace(s, F.lit(sep), F.lit(""))
    return numeric(s).try_cast("bigint")


def parse_decimal(
    c: Column,
    thousand: Sequence[str] = THOUSAND_SEPARATORS,
    decimal: Sequence[str] = DECIMAL_SEPARATORS,
    data_type: str = DECIMAL_TYPE,
) -> Column:
    """Decimal from text whose notation is not known.

    A thousand separator followed by one to three final digits is read as the decimal point, so
    "1,234" is 1.234; use :func:`parse_decimal_locale` when the notation is known.
    """
    s = strip(c)
    for sep in filter(None, thousand):
        s = F.regexp_replace(s, re.escape(sep) + "(?=[0-9]{1,3}$)", ".")
        s = F.replace(s, F.lit(sep), F.lit(""))
    earlier = ""
    for sep in decimal:
        if sep != ".":
            # The last occurrence, unless an earlier separator of the list is there.
            here, others = re.escape(sep), re.escape(earlier)
            head = f"[^{others}]*" if others else ".*"
            s = F.regexp_replace(s, f"^({head}){here}([^{others}{here}]*)$", "$1.$2")
        earlier += sep
    return numeric(s, data_type)


def parse_decimal_locale(c: Column, thousand: str, decimal: str, data_type: str = DECIMAL_TYPE) -> Column:
    """Decimal from text in a known notation."""
    s = strip(c)
    if thousand:
        s = F.replace(s, F.lit(thousand), F.lit(""))
    if decimal != ".":
        # Dots are foreign to this notation: keep them from passing as the point.
        s = F.translate(s, "." + decimal, "?.")
    return numeric(s, data_type)


def money(c: Column) -> Column:
    """Amount with two places, half-even; text that is no number counts as zero, a number too large for MONEY_TYPE is null."""
    exact, size = c.try_cast("decimal(38,10)"), F.abs(c.try_cast("double"))
    beyond = F.coalesce((size >= 1e16) & (size < float("inf")), F.lit(False))
    return F.when(exact.isNotNull(), F.bround(exact, 2).try_cast(MONEY_TYPE)).when(~beyond, F.lit(0).cast(MONEY_TYPE))


def money_product(a: Column, b: Column) -> Column:
    """Product of two exact amounts, rounded half-even to two places; null if it is too large."""
    return F.bround(a * b, 2).try_cast(MONEY_TYPE)


def infer_separators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its (thousand, decimal) separators, from one pass over all values."""
    values = [strip(F.col(name)) for name in columns]
    digits = df.select(*[F.when(v.rlike("[0-9]"), v).alias(f"v{i}") for i, v in enumerate(values)])
    aggregates = []
    for i, name in enumerate(columns):
        value = F.col(f"v{i}")
        after_space = F.substring_index(value, " ", -1)
        commas = F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))
        no = F.lit(False)
        comma_decimal = F.coalesce(F.bool_or(F.contains(after_space, F.lit(","))), no)
        dot_decimal = F.coalesce(F.bool_or(F.contains(after_space, F.lit("."))), no)
        space_thousand = F.coalesce(F.bool_or(F.contains(value, F.lit(" "))), no)
        comma_thousand = F.coalesce(F.bool_or(commas > 1), no)
        notation = (
            F.when(comma_decimal & space_thousand, F.struct(F.lit(" ").alias("thousand"), F.lit(",").alias("decimal")))
            .when(comma_decimal & ~dot_decimal, F.struct(F.lit("").alias("thousand"), F.lit(",").alias("decimal")))
            .when(dot_decimal & comma_thousand, F.struct(F.lit(",").alias("thousand"), F.lit(".").alias("decimal")))
            .otherwise(F.struct(F.lit("").alias("thousand"), F.lit(".").alias("decimal")))
        )
        aggregates.append(F.struct(F.lit(name).alias("column"), notation.alias("notation")).alias(f"_{len(aggregates)}"))
    one = digits.agg(*aggregates)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select(
        "r.column", F.col("r.notation.thousand").alias("thousand_sep"), F.col("r.notation.decimal").alias("decimal_sep")
    )
