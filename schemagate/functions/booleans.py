"""Booleans out of words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemagate.functions.text import strip

# Words and their meaning.
BOOLEAN_WORDS = {
    "да": True, "не": False, "yes": True, "no": False, "true": True, "false": False, "1": True, "0": False,
    "активен": True, "неактивен": False, "active": True, "inactive": False,
}


def parse_boolean(c: Column, words: Mapping[str, bool] = BOOLEAN_WORDS) -> Column:
    s = F.lower(strip(c))
    yes = [w.lower() for w, meaning in words.items() if meaning]
    no = [w.lower() for w, meaning in words.items() if not meaning]
    return F.when(s.isin(yes), True).when(s.isin(no), False)
