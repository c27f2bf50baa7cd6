"""A deterministic embedder: signed feature hashing of content terms. SQL leaves letters and digits; terms are listed and hashed in Python over Arrow batches, as a model would."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ground import lettered_sql, lettered_terms


def hashed(terms: list[str] | None, dimensions: int) -> list[float] | None:
    """Unit vector in which each term adds +1 or -1 at a hashed place; None without terms or if they cancel out."""
    if terms is None or not len(terms):
        return None
    h = np.fromiter((crc32(t.encode()) for t in terms), np.int64, len(terms))
    v = np.bincount(h % dimensions, 1.0 - 2 * (h >> 20 & 1), dimensions)
    size = np.sqrt(v @ v)
    return (v / size).astype(np.float32) if size else None


def embedded(text: str, dimensions: int = 128) -> Column:
    """The vector of a text column, null for a text without terms."""

    @F.pandas_udf("array<float>")
    def unit(texts: pd.Series) -> pd.Series:
        return pd.Series([hashed(lettered_terms(t), dimensions) for t in texts], dtype=object)

    return unit(F.expr(lettered_sql(text)))
