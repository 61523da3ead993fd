"""Row validation: every rule in one projection, errors kept with the row until they are needed."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from schemagate.functions import dates
from schemagate.functions.numbers import DECIMAL_TYPE, numeric
from schemagate.functions.text import EMAIL_PATTERN, strip
from schemagate.plans.skew import HOT_ROWS, flag_repeated
from schemagate.profiles import FieldSpec, Profile

ERRORS = "errors"
EXCLUDED = "excluded"
PARSED = "parsed"
NO_RECORDS = "cast(array() as array<struct<column:string,reason:string,value:string,severity:string>>)"
SEVERITIES = ("error", "warning", "info")

# Formats the validator asks for.
URL_FORMAT = r"(?iU)^https?://[\w\-\.]+(:[0-9]+)?(/.*)?$"
PHONE_FORMAT = r"(?U)^[\+]?[\d\s\(\)\-\.]{7,15}$"


@dataclass(frozen=True)
class Rule:
    """When a row breaks a rule, and the record it then gets."""

    broken: Column
    record: Column
    severity: str = "error"


def rule(broken: Column, column: str, reason: Column | str, value: Column | None = None, severity: str = "error") -> Rule:
    """Rule on one cell; the record shows ``value``, by default the cell."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    value = F.col(column) if value is None else value
    record = F.struct(
        F.lit(column).alias("column"),
        reason.alias("reason"),
        F.coalesce(value.cast("string"), F.lit("")).alias("value"),
        F.lit(severity).alias("severity"),
    )
    return Rule(F.coalesce(broken, F.lit(False)), record, severity)


def required(name: str, cell: Column | None = None, absent: str | None = None) -> Rule:
    """``absent`` names a column that lists what the row's file has no column for: reported for the file, not the row."""
    empty = (F.col(name) if cell is None else cell).isNull()
    return rule(empty if absent is None else empty & ~F.array_contains(absent, name), name, "required_field_missing")


def required_columns(files: DataFrame, matches: DataFrame, targets: Iterable[str]) -> DataFrame:
    """(file_id, target) of required targets that no column of a file is matched with."""
    wanted = files.select("file_id", F.explode(F.array(*map(F.lit, targets)).cast("array<string>")).alias("target"))
    return wanted.join(matches.select("file_id", "target"), ["file_id", "target"], "left_anti")


def column_errors(missing: DataFrame) -> DataFrame:
    """Error records of absent columns (file_id, target), one each, keyed by the file with row -1."""
    return missing.select(
        F.concat_ws("#", "file_id", F.lit("-1")).alias("row_id"), F.col("target").alias("column"), F.lit("required_column_missing").alias("reason"),
        F.lit("column not found in data").alias("value"), F.lit("error").alias("severity"),
    )


def numeric_rules(name: str, kind: str, parsed: Column, low=None, high=None) -> list[Rule]:
    """Type check, then range checks for cells that pass it; ``parsed`` is the cell as a number."""
    rules = [rule(F.col(name).isNotNull() & parsed.isNull(), name, "not_numeric")]
    ok = parsed.isNotNull()
    if kind == "integer":
        whole = parsed == F.floor(parsed)
        rules.append(rule(~whole, name, "not_integer"))
        ok = whole
    if low is not None:
        rules.append(rule(ok & (parsed < F.lit(low)), name, f"below_minimum:{low}"))
    if high is not None:
        rules.append(rule(ok & (parsed > F.lit(high)), name, f"above_maximum:{high}"))
    return rules


def length_rules(name: str, shortest: int | None = None, longest: int | None = None) -> list[Rule]:
    size = F.length(F.col(name).cast("string"))
    rules = []
    if shortest is not None:
        rules.append(rule(size < shortest, name, f"too_short:{shortest}"))
    if longest is not None:
        rules.append(rule(size > longest, name, f"too_long:{longest}"))
    return rules


def pattern_rule(name: str, pattern: str) -> Rule | None:
    """Pattern anchored at the start only; a pattern that does not compile is no rule.

    Named groups are put as Spark's own expressions want them, and the pattern is compiled once here, so that one
    that they refuse never reaches a running query.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    java = f"(?U)^(?:{re.sub(r'[(][?]P=([A-Za-z0-9]+)[)]', r'\\k<\1>', re.sub(r'[(][?]P<', '(?<', pattern))})"
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:
        return None
    return rule(~F.col(name).cast("string").rlike(java), name, f"pattern_mismatch:{pattern}")


def email_rule(name: str) -> Rule:
    return rule(~strip(F.col(name)).rlike(EMAIL_PATTERN), name, "invalid_email_format")


def url_rule(name: str) -> Rule:
    return rule(~strip(F.col(name)).rlike(URL_FORMAT), name, "invalid_url_format")


def phone_rule(name: str) -> Rule:
    return rule(~strip(F.col(name)).rlike(PHONE_FORMAT), name, "invalid_phone_format")


def date_rules(name: str, parsed: Column, first: str | None = None, last: str | None = None) -> list[Rule]:
    rules = [rule(F.col(name).isNotNull() & parsed.isNull(), name, "invalid_date_format")]
    if first:
        rules.append(rule(parsed < F.lit(first).cast("date"), name, f"date_before_minimum:{first}"))
    if last:
        rules.append(rule(parsed > F.lit(last).cast("date"), name, f"date_after_maximum:{last}"))
    return rules


def enum_rule(name: str, allowed: Iterable) -> Rule:
    values = sorted({str(v) for v in allowed})
    return rule(~strip(F.col(name).cast("string")).isin(values), name, f"not_in_allowed_values:{','.join(values)}")


def unique_rule(name: str, flag: str) -> Rule:
    return rule(F.col(flag), name, "duplicate_value")


def cross_rules(profile: Profile, columns: Iterable[str]) -> list[Rule]:
    """Rules over several columns; each applies where its columns exist and hold values.

    Their expressions read the struct ``parsed``, which holds each column as its declared type.
    """
    rules = []
    for spec in profile.cross_rules:
        if not set(spec.needs) <= set(columns):
            continue
        broken = F.expr(spec.condition)
        for need in spec.needs:
            broken = F.col(f"{PARSED}.{need}").isNotNull() & broken
        rules.append(rule(broken, spec.column, F.expr(spec.reason), severity=spec.severity))
    return rules


def with_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the error records of each row, and whether any of them excludes it.

    The flag is made of the conditions alone, so that picking valid rows builds no records.
    """
    excluded = F.lit(False)
    for r in rules:
        if r.severity == "error":
            excluded = excluded | r.broken
    records = F.array_compact(F.array(*[F.when(r.broken, r.record) for r in rules])) if rules else F.expr(NO_RECORDS)
    return df.withColumns({ERRORS: records, EXCLUDED: excluded})


def error_rows(annotated: DataFrame, key: str) -> DataFrame:
    """One row per error record."""
    return annotated.select(F.col(key).alias("row_id"), F.explode(ERRORS).alias("e")).select("row_id", "e.*")


def valid_rows(annotated: DataFrame) -> DataFrame:
    return annotated.filter(~F.col(EXCLUDED)).drop(ERRORS, EXCLUDED)


def rows_without_errors(df: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Valid rows when the error records arrive as a table of their own."""
    excluded = errors.filter((F.col("severity") == "error") & F.col("row_id").isNotNull()).select(
        F.col("row_id").alias(key)
    )
    return df.join(excluded, key, "left_anti")


@dataclass
class Validation:
    """Lazy results of one validation; all share the same annotated plan."""

    annotated: DataFrame
    key: str
    missing_columns: list[str]
    _scratch: tuple[str, ...] = ()
    file_errors: DataFrame | None = None

    @property
    def valid(self) -> DataFrame:
        return valid_rows(self.annotated).drop(*self._scratch)

    @property
    def errors(self) -> DataFrame:
        """Error records; absent required columns add one record each, with row -1 (of the file, in a folder)."""
        found = error_rows(self.annotated, self.key)
        if self.file_errors is not None:
            found = found.unionByName(self.file_errors)
        if not self.missing_columns:
            return found
        spark = self.annotated.sparkSession
        key_type = self.annotated.schema[self.key].dataType
        absent = spark.createDataFrame(
            [(c, "required_column_missing", "column not found in data", "error") for c in self.missing_columns],
            "column string, reason string, value string, severity string",
        ).select(F.lit(-1).cast(key_type).alias("row_id"), "*")
        return found.unionByName(absent)


def _field_rules(name: str, spec: FieldSpec, profile: Profile, numbers: dict[str, str], days: dict[str, str], absent: str | None = None):
    checks = spec.validation or {}
    rules: list[Rule | None] = []
    if spec.required:
        rules.append(required(name, None, absent))
    if name in numbers:
        rules += numeric_rules(name, spec.type, F.col(numbers[name]), checks.get("min_value"), checks.get("max_value"))
    elif spec.type == "string":
        rules += length_rules(name, checks.get("min_length"), checks.get("max_length"))
        if checks.get("pattern"):
            rules.append(pattern_rule(name, checks["pattern"]))
    elif spec.type == "email":
        rules.append(email_rule(name))
    elif spec.type == "url":
        rules.append(url_rule(name))
    elif spec.type == "phone":
        rules.append(phone_rule(name))
    if name in days:
        span = checks.get("date_range") or profile.date_range
        rules += date_rules(name, F.col(days[name]), span.get("min_date"), span.get("max_date"))
    if checks.get("enum_values"):
        rules.append(enum_rule(name, checks["enum_values"]))
    return [r for r in rules if r is not None]


def _parsed(name: str, numbers: dict[str, str], days: dict[str, str]) -> Column:
    if name in numbers:
        return F.col(numbers[name]).cast(DECIMAL_TYPE).alias(name)
    return F.col(days.get(name, name)).alias(name)


def validate(df: DataFrame, profile: Profile, key: str, hot_rows: int = HOT_ROWS, absent: str | None = None) -> Validation:
    """Check every row against the profile; works on raw text and on normalized tables.

    Parsed numbers and dates are projected once and shared by the rules. Only unique columns
    shuffle, and only by digests of their values. Columns kept as ``<name>__raw`` make a malformed
    cell show up as such, instead of as a missing one. ``absent`` names a column that lists the
    targets for which the row's file has no column; their cells are not missing ones.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    present = {n: s for n, s in profile.columns.items() if n in types}
    missing = [n for n, s in profile.columns.items() if s.required and n not in types]

    numbers, days, flags, scratch = {}, {}, {}, {}
    for name, spec in present.items():
        c = F.col(name)
        if spec.type in ("integer", "decimal"):
            plain = isinstance(types[name], NumericType)
            numbers[name] = name if plain else f"__num_{name}"
            if not plain:
                scratch[numbers[name]] = numeric(c)
        elif spec.type in ("date", "datetime"):
            days[name] = f"__day_{name}"
            temporal = isinstance(types[name], (DateType, TimestampType, TimestampNTZType))
            scratch[days[name]] = c.cast("date") if temporal else dates.validated_date(c)
    for name, spec in present.items():
        if (spec.validation or {}).get("unique"):
            flags[name] = f"__repeated_{name}"
            df = flag_repeated(df, name, flags[name], hot_rows)
    df = df.withColumns(scratch)

    rules = []
    for name, spec in present.items():
        raw = f"{name}__raw"
        if raw in types:
            reason = "invalid_date_format" if name in days else "not_numeric" if name in numbers else "invalid_value"
            rules.append(rule(F.col(name).isNull() & F.col(raw).isNotNull(), name, reason, F.col(raw)))
        field_rules = _field_rules(name, spec, profile, numbers, days, absent)
        if raw in types and spec.required:
            field_rules[0] = required(name, F.col(raw), absent)
        rules += field_rules
        if name in flags:
            rules.append(unique_rule(name, flags[name]))
    crossed = cross_rules(profile, present)
    if crossed:
        needed = dict.fromkeys(n for r in profile.cross_rules if set(r.needs) <= set(present) for n in r.needs)
        df = df.withColumn(PARSED, F.struct(*[_parsed(n, numbers, days) for n in needed]))
        scratch[PARSED] = F.col(PARSED)
    rules += crossed
    annotated = with_errors(df, rules)
    return Validation(annotated, key, missing, (*scratch, *flags.values(), *([absent] if absent else [])))


# --- summaries ---------------------------------------------------------------------------------


def errors_by(errors: DataFrame) -> DataFrame:
    """Counts by severity, by column and by reason, in one grouping-sets aggregate."""
    errors = errors.select("severity", "column", "reason")
    sets = [[F.col("severity")], [F.col("column")], [F.col("reason")]]
    counted = errors.groupingSets(sets, F.col("severity"), F.col("column"), F.col("reason")).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n")
    )
    dimension = F.when(F.col("__set") == 3, "severity").when(F.col("__set") == 5, "column").otherwise("reason")
    key = F.coalesce("severity", "column", "reason")
    found = counted.select(dimension.alias("dimension"), key.alias("key"), "n")
    domain = errors.sparkSession.createDataFrame([("severity", s) for s in SEVERITIES], "dimension string, key string")
    return (
        domain.join(found, ["dimension", "key"], "full")
        .select("dimension", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def summary(annotated: DataFrame, column_errors: int = 0) -> DataFrame:
    """One row: totals, rates, verdict and severities, from the rows and their error arrays."""
    def count_of(severity: str) -> Column:
        return F.sum(F.size(F.filter(ERRORS, lambda e: e["severity"] == severity)))

    one = annotated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~F.col(EXCLUDED)).alias("valid_rows"),
        (F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)) + column_errors).cast("bigint").alias("total_errors"),
        *[F.coalesce(count_of(s), F.lit(0)).cast("bigint").alias(f"{s}s") for s in SEVERITIES],
    )
    total = F.col("total_rows")
    invalid = total - F.col("valid_rows")

    def share(n: Column) -> Column:
        return F.when(total > 0, n / total).otherwise(F.lit(0.0))

    return one.select(
        "total_rows",
        "valid_rows",
        invalid.alias("invalid_rows"),
        "total_errors",
        *[f"{s}s" for s in SEVERITIES],
        share(F.col("total_errors")).alias("error_rate"),
        share(invalid).alias("exclusion_rate"),
        (F.col("total_errors") == 0).alias("validation_passed"),
        share(F.col("valid_rows")).alias("data_quality_score"),
    )
