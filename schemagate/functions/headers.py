"""Header text: normal form, similarity, how much a row looks like a header row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemagate.functions.text import strip

# Words replaced inside a header, in this order.
HEADER_WORDS = (
    ("сума", "amount"), ("стойност", "value"), ("период", "period"), ("дата", "date"), ("месец", "month"),
    ("година", "year"), ("отдел", "department"), ("име", "name"), ("код", "code"), ("номер", "number"),
    ("описание", "description"), ("тип", "type"), ("статус", "status"), ("адрес", "address"),
    ("телефон", "phone"), ("email", "email"), ("фирма", "company"), ("организация", "organization"),
    ("amt", "amount"), ("qty", "quantity"), ("количество", "quantity"), ("брой", "count"), ("цена", "price"),
    ("единична_цена", "unit_price"), ("обща_сума", "total_amount"), ("%", " percent "),
    ("дд.мм.гггг", "date"), ("yyyy-mm-dd", "date"), ("mm/dd/yyyy", "date"), ("активен", "active"),
    ("неактивен", "inactive"), ("завършен", "completed"), ("в_процес", "in_progress"),
)
# Cyrillic letters with one Latin letter, then those with several.
LETTERS_FROM, LETTERS_TO = "абвгдезийклмнопрстуфхьъѝ", "abvgdeziyklmnoprstufhyai"
LETTER_GROUPS = (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sht"), ("ю", "yu"), ("я", "ya"))

# What header cells tend to contain, and how row markers begin.
HEADER_HINTS = ("id", "name", "date", "amount", "code", "type")
ROW_MARKERS = ("Row", "row", "Ред", "ред")

MIN_SIMILARITY = 0.7
BOOTSTRAP_SIMILARITY = 0.5


# What a header must hold for the words or letters above to matter.
_TRANSLATABLE = r"[\u0400-\u04FF]|" + "|".join(w for w, r in HEADER_WORDS if w.isascii() and w != r)


def _translate(h: Column) -> Column:
    for word, replacement in HEADER_WORDS:
        if word != replacement:
            h = F.replace(h, F.lit(word), F.lit(replacement))
    h = F.translate(h, LETTERS_FROM, LETTERS_TO)
    for letter, replacement in LETTER_GROUPS:
        h = F.replace(h, F.lit(letter), F.lit(replacement))
    return h


def _fold(stripped: Column) -> Column:
    """Lower case without combining marks."""
    return F.regexp_replace(F.lower(stripped), r"\p{M}+", "")


def _latin(h: Column) -> Column:
    """Folded text in Latin letters; one test spares most headers the list of replacements."""
    return F.when(h.rlike(_TRANSLATABLE), _translate(h)).otherwise(h)


def normalize_header(c: Column) -> Column:
    """Lower-case Latin words joined by underscores; empty for null."""
    h = _latin(_fold(strip(F.coalesce(c, F.lit("")))))
    h = F.regexp_replace(h, r"(?U)[^\w\s]", " ")
    h = F.regexp_replace(strip(h), r"(?U)\s+", "_")
    return F.btrim(h, F.lit("_"))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two normalized headers, 0 to 1.

    Edit distance over the longer length, with small bonuses for containment and for sharing the
    first three characters.
    """
    longest = F.greatest(F.length(a), F.length(b))
    base = F.lit(1.0) - F.levenshtein(a, b) / longest
    contained = F.contains(a, b) | F.contains(b, a)
    base = F.when(contained, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    prefixed = F.startswith(a, F.left(b, F.lit(3))) | F.startswith(b, F.left(a, F.lit(3)))
    score = F.when(prefixed, F.least(F.lit(1.0), base + 0.05)).otherwise(base)
    empty = F.coalesce(F.length(a) == 0, F.lit(True)) | F.coalesce(F.length(b) == 0, F.lit(True))
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(score)


def _cell_score(s: Column, folded: Column) -> Column:
    # Hints are letters only, so separators need not be normalized to find them.
    hinted = _latin(folded).rlike("|".join(HEADER_HINTS))
    marked = s.rlike("^(?:" + "|".join(ROW_MARKERS) + ")")

    def tenths(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    score = (
        tenths(s != "nan", 10)
        + tenths(~s.rlike(r"(?U)^\d+$"), 5)
        + tenths(F.length(s) > 2, 3)
        + tenths(s.rlike(r"\p{L}"), 5)
        + tenths(hinted, 5)
        - tenths(marked, 5)
    )
    return F.when(F.length(s) >= 2, score).otherwise(0)


def header_row_score(cells: Column) -> Column:
    """How much a row of cells looks like headers: points per cell over the width of the row."""
    # Step by step, as a lambda evaluates an expression again wherever it is used.
    stripped = F.transform(cells, strip)
    prepared = F.transform(stripped, lambda s: F.struct(s.alias("s"), _fold(s).alias("folded")))
    points = F.aggregate(prepared, F.lit(0), lambda acc, x: acc + _cell_score(x["s"], x["folded"]))
    return F.when(F.size(cells) > 0, points / (F.size(cells) * 10)).otherwise(0.0)


def is_generic(name: str) -> bool:
    """Whether a column name says nothing about its content."""
    return not name or name.startswith(("Unnamed:", "Column_")) or name.isdigit()


def looks_generic(names: list[str]) -> bool:
    return all(is_generic(n) for n in names)
