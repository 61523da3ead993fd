"""Cron schedules over timestamp columns.

Fields are minute, hour, day, month and weekday; all five must hold. Lists, ranges and steps are
understood; a step after a single number stays that number. Weekdays count from 0 = Sunday, or
from 0 = Monday with ``monday_zero``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest and highest value of each field.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
#: A given weekday on 29 February returns within 40 years, everything else sooner.
HORIZON_DAYS = 41 * 366
SPANS = (7, 31, 93, 366, 8 * 366)


def _field_values(field: str, name: str, low: int, high: int) -> list[int]:
    values: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, dash, last = span.partition("-")
        if span == "*":
            start, end = low, high
        elif dash:
            start, end = int(first), int(last)
        else:
            start = end = int(first)
        values.update(range(start, end + 1, int(step) if step else 1))
    if any(not low <= v <= high for v in values):
        raise ValueError(f"{name} out of {low}-{high}: {field}")
    return sorted(values)


def parse_cron(expression: str) -> dict[str, list[int]]:
    """Valid values of each field; ValueError for a malformed expression."""
    parts = expression.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"expected 5 fields: {expression!r}")
    return {name: _field_values(p, name, low, high) for p, (name, low, high) in zip(parts, FIELDS)}


def _weekday(ts: Column, monday_zero: bool) -> Column:
    return F.weekday(ts) if monday_zero else F.dayofweek(ts) - 1


def cron_match(expression: str, ts: Column, monday_zero: bool = False) -> Column:
    """Whether the schedule fires in the minute of ``ts``."""
    fields = parse_cron(expression)
    parts = {
        "minute": F.minute(ts), "hour": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts),
        "weekday": _weekday(ts, monday_zero),
    }
    hit = F.lit(True)
    for name, low, high in FIELDS:
        if len(fields[name]) < high - low + 1:
            hit = hit & parts[name].isin(fields[name])
    return hit


def _number(c: Column) -> Column:
    # Only digits reach the cast: failed casts are slow.
    return F.when(c.rlike("^[0-9]{1,9}$"), c).cast("int")


def _value_array(field: Column, low: int, high: int) -> Column:
    """Values of a cron field held in a column, null for a malformed one."""
    def values(part: Column) -> Column:
        span, step = F.substring_index(part, "/", 1), F.substring_index(part, "/", -1)
        first, last = _number(F.substring_index(span, "-", 1)), _number(F.substring_index(span, "-", -1))
        start = F.when(span == "*", low).otherwise(first)
        end = F.when(span == "*", high).otherwise(last)
        every = F.when(F.contains(part, F.lit("/")), _number(step)).otherwise(1)
        usable = (start >= low) & (start <= end) & (end <= high) & (every > 0)
        return F.when(usable, F.sequence(start, end, every))

    parts = F.transform(F.split(field, ","), values)
    # Flattening gives null as soon as one part is null.
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def with_next_due(
    df: DataFrame, cron: str, after: str, name: str = "due_at", horizon_days: int = HORIZON_DAYS, monday_zero: bool = False
) -> DataFrame:
    """Add the first minute after column ``after`` at which the schedule in column ``cron`` fires.

    Null for malformed schedules and for those that never fire, such as 30 February; a smaller
    ``horizon_days`` also gives up on later dates. The rest of the first day is searched by minute of
    day and later days by date, so a row costs at most that many dates instead of a calendar of minutes.
    """
    fields = F.split(F.trim(F.col(cron)), r"\s+")
    arrays = {f"__{n}": _value_array(F.get(fields, i), low, high) for i, (n, low, high) in enumerate(FIELDS)}
    # Projected first: lambdas would otherwise parse the schedule anew for every date they look at.
    parsed = df.withColumns(arrays).withColumn("__parts", F.size(fields))
    parsed = parsed.withColumn(
        "__minutes",
        F.flatten(F.transform("__hour", lambda h: F.transform("__minute", lambda m: h * 60 + m))),
    )
    moment = F.col(after)
    today, now = F.to_date(moment), F.hour(moment) * 60 + F.minute(moment)

    def fires_on(d: Column) -> Column:
        return (
            F.array_contains("__day", F.dayofmonth(d))
            & F.array_contains("__month", F.month(d))
            & F.array_contains("__weekday", _weekday(d, monday_zero))
        )

    def first_within(start: int, end: int) -> Column:
        ahead = F.filter(F.sequence(F.lit(start), F.lit(end)), lambda n: fires_on(F.date_add(today, n)))
        return F.date_add(today, F.get(ahead, 0))

    # Most schedules fire soon, so the horizon is searched in growing spans until one has a day.
    ends = [e for e in SPANS if e < horizon_days] + [horizon_days]
    later = F.coalesce(*[first_within(start + 1, end) for start, end in zip([0, *ends], ends)])
    # Days that no listed month has are not searched for.
    days_of = {29: [2], 30: [4, 6, 9, 11], 31: [1, 3, 5, 7, 8, 10, 12]}
    longest = F.greatest(*[F.when(F.arrays_overlap("__month", F.array(*map(F.lit, m))), n) for n, m in days_of.items()])
    later = F.when(F.array_min("__day") <= longest, later)
    parsed = parsed.withColumn(
        "__later_today", F.when(fires_on(today), F.get(F.filter("__minutes", lambda m: m > now), 0))
    ).withColumn("__later_day", F.when(F.col("__later_today").isNull(), later))

    def at(day: Column, minute: Column) -> Column:
        return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute)

    due = F.coalesce(at(today, F.col("__later_today")), at(F.col("__later_day"), F.get("__minutes", 0)))
    out = parsed.withColumn(name, F.when(F.col("__parts") == len(FIELDS), due))
    return out.drop(*arrays, "__parts", "__minutes", "__later_today", "__later_day")
