"""Compatibility composition of Unicode text.

Spark has no built-in for it, so the non-ASCII cells of all given columns go through one Arrow
UDF; ASCII cells are already in that form and reach the UDF as nulls. Each distinct cell of a
batch is composed once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NON_ASCII = r"[^\x00-\x7F]"


def composed_cells(cells: pa.Array) -> pa.Array:
    """NFKC form of each string; nulls stay null."""
    coded = cells.dictionary_encode()
    forms = [unicodedata.normalize("NFKC", v) for v in coded.dictionary.to_pylist()]
    return pa.array(forms, pa.string()).take(coded.indices)


def compose_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each string column by its NFKC form."""
    if not columns:
        return df
    slots = [f"c{i}" for i in range(len(columns))]
    schema = StructType([StructField(s, StringType()) for s in slots])

    @F.pandas_udf(schema)
    def compose(*cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({s: composed_cells(pa.array(cell, pa.string())).to_pandas() for s, cell in zip(slots, cells)})

    composed = compose(*[F.when(F.col(c).rlike(_NON_ASCII), F.col(c)) for c in columns])
    tagged = df.withColumn("__composed", composed)
    replaced = {c: F.coalesce(F.col(f"__composed.{s}"), F.col(c)) for s, c in zip(slots, columns)}
    return tagged.withColumns(replaced).drop("__composed")
