"""Embedding by a function that may fail, as a model behind a network does: retries with growing waits, and error rows in place of a lost job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ATTEMPTS, WAIT_SECONDS = 3, 0.5


def called(embed: Callable, texts: list[str], attempts: int, wait: float):
    """What ``embed`` gives for the texts, tried ``attempts`` times with doubled waits in between; the last error if all fail."""
    for turn in range(attempts):
        try:
            found = list(embed(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception:
            if turn + 1 == attempts:
                raise
            time.sleep(wait * 2**turn)


def checked(vector, dimensions: int) -> list[float]:
    """The vector as floats; an error for a wrong length or a value that is not finite."""
    x = np.asarray(vector, np.float32)
    if x.shape != (dimensions,):
        raise ValueError(f"a vector of shape {x.shape} where {dimensions} values were expected")
    if not np.isfinite(x).all():
        raise ValueError("a value that is not finite")
    return x.tolist()


def _embed(embed: Callable, dimensions: int, at: int, attempts: int, wait: float, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            vectors, errors = [None] * len(texts), [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t]
            for begin in range(0, len(asked), batch_size):
                some = asked[begin : begin + batch_size]
                try:
                    found = dict(zip(some, called(embed, [texts[i] for i in some], attempts, wait), strict=True))
                except Exception:
                    found = {}  # one bad text must not cost the others theirs: each alone
                for i in some:
                    try:
                        vectors[i] = checked(found[i] if i in found else called(embed, [texts[i]], attempts, wait)[0], dimensions)
                    except Exception as broken:
                        errors[i] = str(broken)[:2000] or type(broken).__name__
            yield batch.append_column("embedding", pa.array(vectors, pa.list_(pa.float32()))).append_column("embedding_error", pa.array(errors, pa.string()))

    return run


def embedded_by(df: DataFrame, embed: Callable, dimensions: int, text_col: str = "content", *, attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS, batch_size: int = 64) -> DataFrame:
    """Add embedding and embedding_error: ``embed`` (a list of texts to a list of vectors, in the worker) is called for up to ``batch_size`` texts at once.

    A failing batch is tried ``attempts`` times, then each of its texts alone as often; a text that still fails has a null vector and the last error. Null and empty texts have neither.
    """
    kept = df.drop("embedding", "embedding_error")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    run = _embed(embed, dimensions, kept.columns.index(text_col), attempts, wait, batch_size)
    return kept.mapInArrow(run, types + ", embedding array<float>, embedding_error string")
