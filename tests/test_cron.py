from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from schemagate.functions import cron


@pytest.mark.parametrize("bad", ["* * *", "60 * * * *", "* 25 * * *", "* * 0 * *", "* * * * 7"])
def test_malformed(spark, bad):
    with pytest.raises(ValueError):
        cron.parse_cron(bad)
    df = spark.createDataFrame([(bad, datetime(2025, 1, 1))], "c string, t timestamp_ntz")
    assert cron.with_next_due(df, "c", "t").first().due_at is None


def test_fields():
    assert cron.parse_cron("5/15 1-5/2 1,15 * *") | {"month": 0, "weekday": 0} == {"minute": [5], "hour": [1, 3, 5], "day": [1, 15], "month": 0, "weekday": 0}


def _next(expression, after):
    """Minute by minute."""
    fields, t = cron.parse_cron(expression), after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    while not (t.minute in fields["minute"] and t.hour in fields["hour"] and t.day in fields["day"]
               and t.month in fields["month"] and (t.weekday() + 1) % 7 in fields["weekday"]):
        t += timedelta(minutes=1)
    return t


CASES = [("* * * * *", datetime(2025, 1, 1, 12, 30)), ("0 9 * * *", datetime(2025, 1, 1, 8)), ("0 9 * * *", datetime(2025, 1, 1, 9)),
         ("*/7 3,22 * * 0", datetime(2025, 1, 3, 23, 59, 30)), ("30 14 29 2 *", datetime(2024, 2, 29, 14, 29)), ("0 0 1 1-3/2 *", datetime(2025, 1, 31))]


def test_next_due(spark):
    df = spark.createDataFrame(CASES, "c string, t timestamp_ntz")
    got = [r.due_at for r in cron.with_next_due(df, "c", "t").collect()]
    assert got == [_next(c, t) for c, t in CASES]


def test_next_due_years_ahead(spark):
    cases = [("30 14 29 2 *", datetime(2025, 3, 1), datetime(2028, 2, 29, 14, 30)), ("0 6 29 2 *", datetime(2096, 3, 1), datetime(2104, 2, 29, 6)),
             ("0 0 29 2 1", datetime(2024, 3, 1), datetime(2044, 2, 29)), ("0 0 30 2 *", datetime(2025, 1, 1), None), ("0 0 31 4,6 *", datetime(2025, 1, 1), None)]
    df = spark.createDataFrame([c[:2] for c in cases], "c string, t timestamp_ntz")
    assert [r.due_at for r in cron.with_next_due(df, "c", "t").collect()] == [due for *_, due in cases]


def test_weekday_base(spark):
    monday = spark.createDataFrame([(datetime(2025, 1, 6, 10),)], "t timestamp_ntz")
    hit = lambda e, **k: monday.select(cron.cron_match(e, F.col("t"), **k)).first()[0]
    assert hit("0 10 * * 1") and not hit("0 10 * * 0") and hit("0 10 * * 0", monday_zero=True)
