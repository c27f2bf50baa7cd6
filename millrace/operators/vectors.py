"""Vector operators: checks, normalisation, exact cosine top-k, relative cutoff and token-budgeted selection.

Scores are computed in double precision. Query sides are broadcast only as far as their counted size allows; the per-query top k is pruned before the shuffle by
Spark's window group limit, so a batch of queries moves k rows per task and query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import small_batches

#: Queries are broadcast against all chunks in blocks of up to this many; a larger batch takes one pass over the chunks for each block.
MOST_QUERIES = 20_000
#: Pairs that are scored at once, eight bytes each, and the queries among them.
PAIRS, QUERIES_AT_ONCE = 1_000_000, 2000


def norm(x: str) -> Column:
    return F.sqrt(F.expr(f"aggregate({x}, 0D, (a, e) -> a + cast(e as double) * cast(e as double))"))


def dot(x: str, y: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {y}, (a, b) -> cast(a as double) * cast(b as double)), 0D, (s, v) -> s + v)")


def cosine(x: str, y: str) -> Column:
    """1 - cosine distance; null where a vector is null or of another length, NaN-free: null for zero vectors."""
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size)


def normalized(x: str) -> Column:
    """The vector at unit length; an error for a zero vector, as it has no direction."""
    size = f"sqrt(aggregate({x}, 0D, (a, e) -> a + cast(e as double) * cast(e as double)))"
    return F.expr(let("n", size, f"IF(n > 0, transform({x}, e -> cast(e as double) / n), cast(raise_error('zero vector') as array<double>))"))


def is_valid(x: str, dimensions: int) -> Column:
    """Whether a vector is present, of the right length and finite throughout."""
    return F.coalesce(F.expr(f"size({x}) = {dimensions} AND forall({x}, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of vectors without nulls and with a direction, and those vectors at unit length."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        values = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        with np.errstate(invalid="ignore", over="ignore"):
            norms = np.sqrt((values * values).sum(axis=1))
        good = np.isfinite(norms) & (norms > 0)
        out[size] = at[good], values[good] / norms[good, None]
    return out


def _scores(asked, min_score: float, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, probes = asked.value
        # The best scores of each query so far: what is below its ``most`` best of this task cannot be among its best at all.
        best = {size: np.full((most, len(places)), -np.inf) for size, (places, _) in queries.items()} if most is not None else {}
        for batch in batches:
            for size, (at, rows) in matrix(batch.column("embedding")).items():
                if size not in queries:
                    continue
                places, units = queries[size]
                cells = batch.column("cell").to_numpy(zero_copy_only=False)[at] if probes is not None else None
                for first in range(0, len(places), QUERIES_AT_ONCE):
                    block = slice(first, first + QUERIES_AT_ONCE)
                    step = max(1, PAIRS // len(places[block]))
                    for begin in range(0, len(at), step):
                        score = rows[begin : begin + step] @ units[block].T
                        keep = score >= min_score
                        if probes is not None:
                            keep &= probes[places[block]].T[cells[begin : begin + step]]
                        if most is not None:
                            score[~keep] = -np.inf
                            held = np.concatenate([best[size][:, block], score])
                            held.partition(len(score), axis=0)
                            best[size][:, block] = held[len(score) :]
                            keep &= score >= held[len(score)]
                        row, query = np.nonzero(keep)
                        if len(row):
                            own = batch.select(["chunk_id", "kb_id", "token_count"]).take(pa.array(at[begin + row]))
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[block][query])), *own.columns, pa.array(score[row, query])], ["query_id", "chunk_id", "kb_id", "token_count", "score"])

    return run


def scored(queries: DataFrame, chunks: DataFrame, min_score: float, ready: DataFrame | None = None, only: list | None = None, most: int | None = None, probes: Callable | None = None) -> DataFrame:
    """query_id, chunk_id, kb_id, token_count, score of all pairs at or above min_score; with ``most``, of those that can be among a query's ``most`` best.

    queries: query_id, query; chunks: chunk_id, kb_id, token_count, embedding; ready: kb_id of the knowledge bases to search; only: null or empty for all. Vectors that are null,
    of another length, not finite or zero meet nothing. ``probes`` gives for unit queries by rows the cells to look into, for chunks with a cell.
    """
    pool = chunks
    if ready is not None:
        pool = pool.join(ready.select("kb_id"), "kb_id", "left_semi")
    if only:
        pool = pool.where(F.col("kb_id").isin(only))
    asked = queries.select("query_id", "query").toArrow()
    pool = pool.select("chunk_id", "kb_id", "token_count", "embedding", *(["cell"] if probes else []))
    types = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((queries, "query_id"), (pool, "chunk_id"), (pool, "kb_id"), (pool, "token_count")))
    small_batches(queries.sparkSession)
    blocks = [_scored(asked.slice(at, MOST_QUERIES), pool, min_score, most, probes, types + ", score double") for at in range(0, max(1, asked.num_rows), MOST_QUERIES)]
    return reduce(DataFrame.unionAll, blocks)


def _scored(asked: pa.Table, pool: DataFrame, min_score: float, most: int | None, probes: Callable | None, types: str) -> DataFrame:
    """``scored`` for one block of queries."""
    by_size, looked = matrix(asked.column("query")), None
    if probes:
        looked = np.zeros((asked.num_rows, 0), bool)
        for at, units in by_size.values():
            own = probes(units)
            looked = np.zeros((asked.num_rows, own.shape[1]), bool)
            looked[at] = own
        pool = pool.where(F.col("cell").isin(np.flatnonzero(looked.any(axis=0)).tolist()))
    shared = pool.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), by_size, looked))
    return pool.mapInArrow(_scores(shared, min_score, most), types)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; equal scores go by chunk id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def over_fetch(k: int) -> int:
    return max(3 * k, 12)


def relative_cutoff(found: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """Hits that score at least ``cutoff`` of their query's best."""
    return found.withColumn("best", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= F.col("best") * cutoff).drop("best")


def select_within_budget(found: DataFrame, k: int = 4, max_tokens: int = 1100, k_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """Greedy selection by rank: the first hit always, later ones if they fit the token budget (others are skipped), k at most. A fold over a query's few hits."""
    most, budget = (f"s.{k_col}" if k_col else str(k)), (f"s.{tokens_col}" if tokens_col else str(max_tokens))
    names = [c for c in found.columns if c != "query_id"]
    every = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in names if c != "rank"]))).alias("hits"))
    fits = f"size(a.kept) < {most} AND (size(a.kept) = 0 OR a.tokens + s.token_count <= {budget})"
    start = "named_struct('tokens', 0L, 'kept', slice(hits, 1, 0))"
    step = f"IF({fits}, named_struct('tokens', a.tokens + s.token_count, 'kept', concat(a.kept, array(s))), a)"
    return every.withColumn("hits", F.expr(f"aggregate(hits, {start}, (a, s) -> {step}, a -> a.kept)")).select("query_id", F.inline("hits"))
