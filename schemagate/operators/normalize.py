"""Cleanup and normalization of whole tables, as one projection built from a profile."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from schemagate.functions import booleans, dates, numbers, text
from schemagate.functions.unicode import compose_columns
from schemagate.profiles import FieldSpec, NormalizationSpec, Profile

SEMANTIC_TYPES = ("email", "phone", "url")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def clean_cells(df: DataFrame, tokens: Iterable[str] = text.NULL_TOKENS) -> DataFrame:
    """Null tokens to null, edges trimmed, empty cells to null, in every string column."""
    tokens = list(tokens)
    return df.withColumns({c: text.trim_cell(text.null_tokens(F.col(c), tokens)) for c in string_columns(df)})


def drop_empty_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows in which all the given columns (default: all) are null."""
    return df.na.drop(how="all", subset=list(columns) if columns else None)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value, found by one aggregate over the table."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if counts[i] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def name_unnamed(df: DataFrame) -> DataFrame:
    """Give columns without a usable name the names Column_1, Column_2, ..."""
    names, n = [], 0
    for c in df.columns:
        if not c.strip() or c.startswith("Unnamed:"):
            n += 1
            names.append(f"Column_{n}")
        else:
            names.append(c.strip())
    return df.toDF(*names)


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Rename source columns to their targets; also return the columns left unmapped."""
    unmapped = [c for c in df.columns if c not in mapping]
    return df.withColumnsRenamed(dict(mapping)), unmapped


def reheader(df: DataFrame, row_id: str, header_row: int, headers: list[str]) -> DataFrame:
    """Keep the rows after the header row and name the columns by it, if the widths agree."""
    data = [c for c in df.columns if c != row_id]
    below = df.filter(F.col(row_id) > header_row)
    if len(headers) != len(data):
        return below
    return below.select(row_id, *[F.col(f"`{c}`").alias(h) for c, h in zip(data, headers)])


def normalize_value(c: Column, spec: FieldSpec, norm: NormalizationSpec) -> Column:
    """One cell by its declared type."""
    match spec.type:
        case "integer":
            return numbers.parse_integer(c, norm.thousand_sep)
        case "decimal":
            return numbers.parse_decimal(c, norm.thousand_sep, norm.decimal_sep)
        case "date":
            return dates.parse_date(c, [*spec.format, *norm.date_formats])
        case "datetime":
            return dates.parse_datetime(c)
        case "boolean":
            return booleans.parse_boolean(c, norm.boolean_values)
        case "email":
            return text.normalize_email(c, spec.transformation)
        case "phone":
            return text.normalize_phone(c)
        case "url":
            return text.normalize_url(c, spec.transformation)
        case _:
            return text.normalize_string(c, spec.transformation)


def normalize_table(
    df: DataFrame,
    profile: Profile,
    apply_defaults: bool = False,
    keep_raw: bool = False,
    unicode: bool | None = None,
) -> DataFrame:
    """Trim, compose Unicode, then type every profiled column; other columns pass through.

    ``keep_raw`` keeps the trimmed text next to each typed column as ``<name>__raw``, so that the
    validator can tell a malformed cell from a missing one. ``unicode`` overrides the profile.
    """
    norm = profile.normalization
    strings = string_columns(df)
    if norm.trim_whitespace:
        df = df.withColumns({c: text.trim_cell(F.col(c)) for c in strings})
    if norm.normalize_unicode if unicode is None else unicode:
        df = compose_columns(df, strings)
    typed = {}
    for target, spec in profile.columns.items():
        if target not in df.columns:
            continue
        value = normalize_value(F.col(target), spec, norm)
        if apply_defaults and spec.default is not None:
            value = F.coalesce(value, F.lit(spec.default))
        typed[target] = value
        if keep_raw and spec.type not in ("string", *SEMANTIC_TYPES):
            typed[f"{target}__raw"] = F.col(target)
    out = df.withColumns(typed)
    for target, spec in profile.columns.items():
        if spec.type in SEMANTIC_TYPES and target in out.columns:
            out = out.withMetadata(target, {"semantic": spec.type})
    return out


def redact_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace the named columns by digests, where present."""
    return df.withColumns({c: text.redact(F.col(c)) for c in columns if c in df.columns})


def preview(df: DataFrame, row_id: str, n: int = 10, after: int | None = None) -> DataFrame:
    """First ``n`` rows by row id, optionally those after a header row."""
    rows = df if after is None else df.filter(F.col(row_id) > after)
    return rows.orderBy(row_id).limit(n)
