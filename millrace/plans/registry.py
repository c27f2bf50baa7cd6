"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, catalog_queries, chunk_queries, engine_queries, fixture_queries, text_queries, url_queries, vector_queries

_MODULES = (text_queries, chunk_queries, url_queries, vector_queries, answer_queries, catalog_queries, engine_queries, fixture_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch answers: documents are cleaned, chunked and embedded; questions retrieve, pass the grounding gate and cite their sources."""
    return engine_queries.ask_batch(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
