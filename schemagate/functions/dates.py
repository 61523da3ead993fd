"""Dates and timestamps out of text, by explicit formats.

Every format becomes one regular expression that rewrites the text to ISO order; the cast from
ISO text is cheap and yields null for impossible dates, without an exception per bad cell.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemagate.functions.text import strip

# Formats tried in this order.
DEFAULT_DATE_FORMATS = ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m", "%d.%m.%y")
VALIDATOR_DATE_FORMATS = ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m")
DATETIME_FORMATS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S",
    "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%d.%m.%Y %H:%M", "%d/%m/%Y %H:%M",
    "%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y",
)
# Reader-friendly format letters.
FRIENDLY_LETTERS = {"YYYY": "%Y", "YY": "%y", "MM": "%m", "DD": "%d", "HH": "%H", "mm": "%M", "SS": "%S"}

_FIELDS = {
    "Y": r"([0-9]{4})",
    "y": r"([0-9]{2})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12][0-9]|0[1-9]|[1-9])",
    "H": r"(2[0-3]|[01][0-9]|[0-9])",
    "M": r"([0-5][0-9]|[0-9])",
    "S": r"([0-5][0-9](?:\.[0-9]{1,6})?|[0-9])",
}


def to_percent_format(fmt: str) -> str:
    """``YYYY-MM-DD`` style to ``%Y-%m-%d`` style; the latter passes unchanged."""
    for letters, directive in FRIENDLY_LETTERS.items():
        fmt = fmt.replace(letters, directive)
    return fmt


def _iso_rewrite(fmt: str) -> tuple[str, dict[str, int]]:
    """Pattern for ``fmt`` and the capture group of each field."""
    pattern, groups = "", {}
    for literal, letter in re.findall(r"([^%]+)|%(.)", to_percent_format(fmt)):
        if literal:
            pattern += re.escape(literal)
        else:
            groups[letter] = len(groups) + 1
            pattern += _FIELDS[letter]
    return f"^{pattern}$", groups


def from_format(c: Column, fmt: str, data_type: str = "date") -> Column:
    """Text in ``fmt`` as date or timestamp; missing day or time parts take their first value."""
    pattern, at = _iso_rewrite(fmt)

    def part(letter: str, default: str) -> str:
        return f"${at[letter]}" if letter in at else default

    year = part("Y", f"20{part('y', '00')}")
    iso = f"{year}-{part('m', '01')}-{part('d', '01')}"
    if data_type != "date":
        iso += f" {part('H', '00')}:{part('M', '00')}:{part('S', '00')}"
    value = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, iso)).try_cast(data_type)
    if "y" in at:
        # Two-digit years from 69 on belong to the last century.
        shifted = F.add_months(value, -1200) if data_type == "date" else value - F.expr("interval 100 years")
        value = F.when(F.year(value) >= 2069, shifted).otherwise(value)
    return value


def parse_date(c: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    s = strip(c)
    return F.coalesce(*[from_format(s, f) for f in dict.fromkeys(map(to_percent_format, formats))])


def parse_datetime(c: Column, formats: Sequence[str] = DATETIME_FORMATS) -> Column:
    s = strip(c)
    return F.coalesce(*[from_format(s, f, "timestamp_ntz") for f in dict.fromkeys(map(to_percent_format, formats))])


def validated_date(c: Column) -> Column:
    """Date as the validator reads it: its five formats, then an ISO date with or without time."""
    iso = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.left(c, F.lit(10))).try_cast("date")
    with_time = c.try_cast("timestamp_ntz")
    return F.coalesce(
        *[from_format(c, f) for f in VALIDATOR_DATE_FORMATS],
        F.when(with_time.isNotNull(), iso),
    )


def date_prefix(c: Column) -> Column:
    """Text before the first space."""
    return F.substring_index(c, " ", 1)
