"""Vectors that can be compared by cosine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units(embeddings) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.stack([np.asarray(e, np.float64) for e in embeddings])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
