"""An approximate vector index: vectors in cells around centres, and a search that looks into the cells nearest to a query.

Centres are fitted on a bounded sample; every row gets a cell. A search scores rows where they lie, so neither building nor searching shuffles, and one crowded cell is no single task.
A table written by cell lets a search skip the files of cells that no query looks into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Bounds of the fit: vectors that centres are fitted on, and those of them that set how many cells a search looks into.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 400


@dataclass(frozen=True)
class Centres:
    """Unit centres, and how many of the nearest ones a search looks into."""

    units: np.ndarray
    probes: int

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """Whether each query (rows) looks into each cell (columns)."""
        close = queries @ self.units.T
        most = min(self.probes, len(self.units))
        return close >= np.partition(close, len(self.units) - most, axis=1)[:, len(self.units) - most, None]


def fit(chunks: DataFrame, cells: int = 64, k: int = 10, recall: float = 0.97, *, sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES, rounds: int = 12, seed: int = 3) -> Centres:
    """Centres by spherical k-means on at most ``sample_rows`` vectors in the order of their hashed ids, and the fewest probes that find a share of ``recall`` of the k best among these for sampled queries."""
    rows = chunks.select("chunk_id", "embedding").where("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).toArrow()
    found = vectors.matrix(rows.column("embedding"))
    if not found:
        raise ValueError("no vector to fit an index on")
    x = max(found.values(), key=lambda f: len(f[0]))[1]
    rng = np.random.default_rng(seed)
    units = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        cell = (x @ units.T).argmax(axis=1)
        total = np.zeros_like(units)
        np.add.at(total, cell, x)
        size = np.sqrt((total * total).sum(axis=1))
        units = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], units)
    cell = (x @ units.T).argmax(axis=1)
    asked = x[:sample_queries]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ units.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1)
    probes = next((p for p in range(1, len(units)) if (needed < p).mean() >= recall), len(units))
    return Centres(units, probes)


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1)
            at, rows = vectors.matrix(batch.column("embedding")).get(units.shape[1], (np.empty(0, int), None))
            if len(at):
                cell[at] = (rows @ units.T).argmax(axis=1)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return run


def indexed(chunks: DataFrame, centres: Centres) -> DataFrame:
    """Every row of chunks with its cell; -1 for vectors that no search can meet."""
    shared = chunks.sparkSession.sparkContext.broadcast(centres.units)  # a plain array: what is broadcast is no code that travels with the plan
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "cell")
    return chunks.drop("cell").mapInArrow(_cells(shared), types + ", cell int")


def search(queries: DataFrame, index: DataFrame, centres: Centres, k: int, min_score: float = -1.0, **more) -> DataFrame:
    """The k best of each query among the rows of its nearest cells, as ``vectors.top_k`` gives them."""
    return vectors.top_k(vectors.scored(queries, index, min_score, most=k, probes=centres.nearest, **more), k)
