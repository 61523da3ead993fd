from conftest import rows
from pyspark.sql import functions as F

from schemagate.operators import normalize, validate
from schemagate.profiles import FieldSpec, Profile, load_profile, profile_from_dict

BUDGET = load_profile("budget_execution_v1")


def test_profiles():
    assert len(BUDGET.columns) == 12 and BUDGET.required_fields() == [
        "period", "department", "budget_line", "planned_amount", "executed_amount"
    ]
    assert BUDGET.field_by_source("Dept")[0] == "department"
    assert load_profile("budget_execution_v1") is BUDGET
    raw = {"profile": "P", "columns": {"a": {"sources": ["A"], "format": "YYYY"}}}
    assert profile_from_dict(raw).columns["a"].format == ("YYYY",)


def test_raw_rows(spark):
    data = [(0, "2024-03-02", "Harbour", "HB-7", "130", "-4"), (1, "2024-03-09", "Parks", "PK-2", "71", "88")]
    df = spark.createDataFrame(data, "row_id bigint, period string, department string, budget_line string, execution_percentage string, planned_amount string")
    checked = validate.validate(df, BUDGET, "row_id")
    assert rows(checked.errors, "row_id", "column", "reason", "value", "severity") == sorted([
        (-1, "executed_amount", "required_column_missing", "column not found in data", "error"),
        (0, "execution_percentage", "above_maximum:100", "130", "error"),
        (0, "planned_amount", "below_minimum:0", "-4", "error"),
    ], key=lambda r: tuple((True, str(v)) for v in r))
    assert [r.row_id for r in checked.valid.collect()] == [1]
    assert checked.valid.columns == df.columns


def test_cross_rules_on_text(spark):
    data = [("a", "100", "106", "x", "50"), ("b", "100", "50", "50", "50"), ("c", "100", "50", "10", "90")]
    df = spark.createDataFrame(data, "k string, planned_amount string, executed_amount string, remaining_amount string, execution_percentage string")
    errors = validate.validate(df, BUDGET, "k").errors.filter("severity = 'warning'")
    assert rows(errors, "row_id", "reason", "value") == [
        ("a", "execution_exceeds_planned:100.00", "106"), ("a", "inconsistent_percentage:106.0", "50"),
        ("c", "inconsistent_calculation:50.00", "10"), ("c", "inconsistent_percentage:50.0", "90"),
    ]


def test_uniqueness_and_bad_pattern(spark):
    profile = Profile("p", {"v": FieldSpec(("v",), validation={"unique": True, "pattern": "(", "min_length": 2})})
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, v string")
    checked = validate.validate(df, profile, "id")
    assert rows(checked.errors, "row_id", "reason") == [(1, "duplicate_value"), (2, "duplicate_value"), (3, "too_short:2")]
    assert rows(checked.valid) == [(4, None)]


def test_malformed_cells_after_normalization(spark):
    profile = Profile("p", {"amount": FieldSpec(("A",), "decimal", required=True), "day": FieldSpec(("D",), "date")})
    df = spark.createDataFrame([(1, "x", "soon"), (2, None, "2025-01-01"), (3, "5", None)], "id int, amount string, day string")
    plain = validate.validate(normalize.normalize_table(df, profile), profile, "id")
    assert rows(plain.errors, "row_id", "reason") == [(1, "required_field_missing"), (2, "required_field_missing")]
    kept = validate.validate(normalize.normalize_table(df, profile, keep_raw=True), profile, "id")
    assert rows(kept.errors, "row_id", "reason") == [(1, "invalid_date_format"), (1, "not_numeric"), (2, "required_field_missing")]


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "id int, v string")
    checked = validate.validate(df, Profile("p", {"v": FieldSpec(("v",), required=True)}), "id")
    r = validate.summary(checked.annotated).first()
    assert (r.total_rows, r.total_errors, r.error_rate, r.validation_passed) == (0, 0, 0.0, True)
    assert rows(validate.errors_by(checked.errors)) == [("severity", s, 0) for s in ("error", "info", "warning")]


def test_bulgarian_status_excludes_row(spark):
    df = spark.createDataFrame(
        [(0, "2025-01", "образование", "EDU.01", "150 000,50", "145 230,25", "активен"), (1, "2025-01", "x", "y", "1", "1", "Active")],
        "row_id bigint, period string, department string, budget_line string, planned_amount string, executed_amount string, status string",
    )
    checked = validate.validate(normalize.normalize_table(df, BUDGET), BUDGET, "row_id")
    valid = checked.valid.select("row_id", F.col("period").cast("string"), "department", "status").collect()
    assert [tuple(r) for r in valid] == [(1, "2025-01-01", "X", "active")]
    assert rows(checked.errors, "reason") == [("not_in_allowed_values:active,cancelled,completed,inactive",)]


def test_unicode_classes(spark):
    cases = [("Иван", r"(?U)^(?:\w+$)"), ("+359\u00a02\u00a0123\u00a0456", validate.PHONE_FORMAT), ("https://пример.бг/път", validate.URL_FORMAT)]
    assert spark.range(1).select(*(F.lit(text).rlike(pattern) for text, pattern in cases)).first() == (True, True, True)


def test_patterns_of_either_notation(spark):
    """Named groups work as they are written; a pattern that only one of the two engines takes is no rule."""
    df = spark.createDataFrame([("ab",), ("aa",)], "v string")
    broken = lambda p: [r[0] for r in df.select(validate.pattern_rule("v", p).broken).collect()]
    assert broken(r"(?P<a>\w)(?P=a)") == [True, False] and broken("(?P<x>a)b") == [False, True]
    assert validate.pattern_rule("v", "(?(1)a|b)(x)") is None and validate.pattern_rule("v", "(") is None
