from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from schemagate.functions import booleans, dates, numbers, text
from schemagate.functions.unicode import compose_columns


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_decimal_without_known_notation(spark):
    got = apply(spark, numbers.parse_decimal, [
        "150 000,50", "1,234", "1 234", "1,234,567", "72.150,80", "12.5", "1.0d", "nan", "inf", "1_000", None, "", "-5,5", "1,23456",
    ])
    want = ["150000.50", "1.234", "1.234", "1234.567", None, "12.5", None, None, None, None, None, None, "-5.5", "123456"]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_decimal_with_known_notation(spark):
    eu = lambda c: numbers.parse_decimal_locale(c, " ", ",")
    assert apply(spark, eu, ["1 234,56", "72.150,80", "7"]) == [Decimal("1234.56"), None, Decimal("7")]
    us = lambda c: numbers.parse_decimal_locale(c, ",", ".")
    assert apply(spark, us, ["1,234.56", "1,234"]) == [Decimal("1234.56"), Decimal("1234")]


def test_integer(spark):
    assert apply(spark, numbers.parse_integer, ["1 234", "1,5", "-7.9", "abc", "1e3", None]) == [1234, 15, -7, None, 1000, None]


def test_money_is_half_even(spark):
    got = apply(spark, numbers.money, ["0.125", "0.135", "n/a", None, "2"])
    assert got == [Decimal(x) for x in ("0.12", "0.14", "0.00", "0.00", "2.00")]


def test_dates(spark):
    got = apply(spark, dates.parse_date, ["2025-1-5", "05.01.2025", "5/1/2025", "12/25/2024", "2025-03", "1.2.70", "1.2.25", "31.02.2025", "soon"])
    want = [date(2025, 1, 5)] * 3 + [date(2024, 12, 25), date(2025, 3, 1), date(1970, 2, 1), date(2025, 2, 1), None, None]
    assert got == want
    assert dates.to_percent_format("DD.MM.YYYY HH:mm") == "%d.%m.%Y %H:%M"


def test_datetimes(spark):
    got = apply(spark, dates.parse_datetime, ["01.02.2025 10:30", "2025-02-01T10:30:15", "1/2/2025", "x"])
    assert got == [datetime(2025, 2, 1, 10, 30), datetime(2025, 2, 1, 10, 30, 15), datetime(2025, 2, 1), None]


def test_words_and_contacts(spark):
    assert apply(spark, booleans.parse_boolean, [" ДА ", "inactive", "maybe", None]) == [True, False, None, None]
    assert apply(spark, text.normalize_email, [" A.b@X.COM", "a@b", None]) == ["a.b@x.com", None, None]
    assert apply(spark, text.normalize_phone, ["+359 (2) 12-3", "none", None]) == ["359212" + "3", None, None]
    assert apply(spark, text.normalize_url, ["x.com/a", "http://y", "a b", ""]) == ["https://x.com/a", "http://y", None, None]


def test_text(spark):
    assert apply(spark, text.title_case, ["maria-johnson o'neil 3rd"]) == ["Maria-Johnson O'Neil 3Rd"]
    assert apply(spark, text.trim_cell, ["\xa0 a \t", "  ", None]) == ["a", None, None]
    assert apply(spark, text.null_tokens, ["NA", " NA ", "x", "#NULL!"]) == [None, " NA ", "x", None]


def test_slugs(spark):
    df = spark.createDataFrame(
        [("municipality-sofia", "budget-2025"), ("Test Org!!!", "Dataset#123"), ("a" * 50, "b" * 50)], "o string, d string"
    )
    got = [r.s for r in df.select(text.package_slug(F.col("o"), F.col("d")).alias("s")).collect()]
    assert got[:2] == ["municipality-sofia-budget-2025", "test-org-dataset-123"]
    assert len(got[2]) == 89 and got[2].startswith("a" * 50 + "-" + "b" * 29 + "-")


def test_unicode_letters_with_marks(spark):
    """й, Й, é, è and Ü stay or become one letter, whichever way they come in."""
    loose = ["Раи\u0306он", "И\u0306ога", "cafe\u0301", "e\u0300", "U\u0308ber", "ascii", None, "", "ﬁ\u00a0①"]
    joined = ["Район", "Йога", "café", "è", "Über", "ascii", None, "", "fi 1"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(loose, joined))], "id int, a string, b string")
    got = compose_columns(df, ["a", "b"]).orderBy("id").collect()
    assert [r.a for r in got] == joined and [r.b for r in got] == joined


def test_unicode(spark):
    df = spark.createDataFrame([(1, "ﬁne", "x"), (2, None, "½"), (3, "A\xa0b", None)], "i int, a string, b string")
    got = [tuple(r) for r in compose_columns(df, ["a", "b"]).orderBy("i").collect()]
    assert got == [(1, "fine", "x"), (2, None, "1⁄2"), (3, "A b", None)]


@pytest.mark.parametrize("values,want", [(["1 234,56", "7 000,00"], (" ", ",")), (["1234,5"], ("", ",")), (["1,234,567.8"], (",", ".")), (["abc"], ("", "."))])
def test_separators(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = numbers.infer_separators(df, ["v"]).first()
    assert (r.thousand_sep, r.decimal_sep) == want


def test_amounts_out_of_range(spark):
    """A number that the money type cannot hold is null, text that is no number is zero."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["12345678901234567.00", "-1e40", "9999999999999999.99", "nan", "n/a", None, "1.005"])], "i int, v string")
    got = [r.m for r in df.select("i", numbers.money(df.v).alias("m")).orderBy("i").collect()]
    assert [None if m is None else str(m) for m in got] == [None, None, "9999999999999999.99", "0.00", "0.00", "0.00", "1.00"]
