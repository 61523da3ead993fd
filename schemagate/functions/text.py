"""String normalizers as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character stripped from the edges of a cell.
EDGE_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)

# Cell texts read as null, first the declared ones, then the CSV reader's usual ones.
NULL_TOKENS = (
    "", "NA", "N/A", "NULL", "null", "#N/A", "#NULL!",
    "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "NaN", "None", "n/a", "nan",
)
WORKBOOK_NULL_TOKENS = (*NULL_TOKENS, "#DIV/0!")

# Formats a cell must have.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_PATTERN = r'^https?://[^\s<>"]+$'

# Mime type by file extension.
MIME_TYPES = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "json": "application/json",
    "pdf": "application/pdf",
}
DEFAULT_MIME_TYPE = "application/octet-stream"


def strip(c: Column) -> Column:
    """Cut Unicode whitespace (no-break space included) from both ends."""
    return F.btrim(c, F.lit(EDGE_WHITESPACE))


def trim_cell(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def null_tokens(c: Column, tokens: Iterable[str] = NULL_TOKENS, strip_first: bool = False) -> Column:
    """Null for cells that spell "no value"; ``strip_first`` also catches padded tokens."""
    probe = strip(c) if strip_first else c
    return F.when(~probe.isin(list(tokens)), c)


def present(c: Column) -> Column:
    """Stripped cell, null when empty or spelled nan/null in any case."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "nan", "null"), s)


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the others."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_string(c: Column, transformation: str | None = None) -> Column:
    c = F.when(c != "nan", c)
    if transformation == "upper":
        return F.upper(c)
    if transformation == "lower":
        return F.lower(c)
    if transformation == "title":
        return title_case(c)
    return c


def normalize_email(c: Column, transformation: str | None = None) -> Column:
    s = F.lower(strip(normalize_string(c, transformation)))
    return F.when(s.rlike(EMAIL_PATTERN), s)


def normalize_phone(c: Column) -> Column:
    """Digits of the cell; a leading plus sign is not kept."""
    return F.nullif(F.regexp_replace(present(c), "[^0-9]", ""), F.lit(""))


def normalize_url(c: Column, transformation: str | None = None) -> Column:
    """Give scheme-less addresses https, null what still is no address."""
    s = F.when(~strip(c).isin("", "nan"), strip(normalize_string(c, transformation)))
    full = F.when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.when(full.rlike(URL_PATTERN), full)


def safe_filename(c: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9\-_.]", "_"), F.lit(80))


def package_slug(org: Column, dataset: Column) -> Column:
    """Dash-separated lower-case name; long ones end in a digest of the full name."""
    full = F.concat(org, F.lit("-"), dataset)
    dashed = F.regexp_replace(F.lower(full), r"[^\p{L}\p{N}]+", "-")
    name = F.btrim(dashed, F.lit("-"))
    short = F.concat(F.left(name, F.lit(80)), F.lit("-"), F.left(F.md5(full), F.lit(8)))
    return F.when(F.length(name) > 90, short).otherwise(name)


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def mime_type(path: Column) -> Column:
    extension = file_extension(path)
    out = F.lit(DEFAULT_MIME_TYPE)
    for ext, mime in reversed(MIME_TYPES.items()):
        out = F.when(extension == ext, F.lit(mime)).otherwise(out)
    return out


def export_base_name(org: Column, dataset: Column, at: Column) -> Column:
    """Name of an export, without extension."""
    return F.concat_ws("_", dataset, org, F.date_format(at, "yyyyMMdd_HHmmss"))


def redact(c: Column) -> Column:
    """Irreversible stand-in for a personal value; equal values stay equal."""
    return F.sha2(c.cast("string"), 256)
