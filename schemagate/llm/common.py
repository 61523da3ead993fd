"""Helpers of the corpus operators: tables kept between jobs, words, hashes."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-tables-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where a local session names none, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8; bytes.split() knows exactly the ASCII white space of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a number of rows and, where a text alone is not longer, bytes of text: what a task holds at once."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        ends = sum((np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = max(at + 1, min(at + rows, fit))
            yield batch.slice(at, to - at)
            at = to


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the keys come out once."""
    right = right.withColumnsRenamed({n: f"_same_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_same_{n}")) for n in names]
    return left.join(right, on, how).drop(*(f"_same_{n}" for n in names))


def share(spark: SparkSession, value):
    """Broadcast an object of this package by value; `shared(...)` is it again on an executor."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent):
    return pickle.loads(sent.value)


def of_worker(key: tuple, make: Callable):
    """What `make()` gives, made once in a Python worker process and kept there from task to task.

    Functions of this package travel by value, so its own modules are new in each task and keep nothing.
    """
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
