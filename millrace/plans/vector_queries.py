"""Retrieval queries over embeddings: vectors are chunks, labels knowledge bases, token counts are made from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import vectors as v
from ..sources.tables import table

_TOKENS = "cast(100 + (vec_id * 37) % 400 as int)"


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), F.expr(_TOKENS).alias("token_count"), "embedding")


def asked(spark, sf_dir, where):
    """A stated set of query vectors: those of some ids."""
    return table(spark, sf_dir, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _shown(df):
    return df.select("query_id", "chunk_id", "kb_id", F.round("score", 6).alias("score"))


def _hits(spark, sf_dir, where="vec_id % 20 = 0", min_score=0.1, k=12, **more):
    return v.top_k(v.scored(asked(spark, sf_dir, where), chunks(spark, sf_dir), min_score, most=k, **more), k)


def topk_search(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, k=6))


def topk_search_filtered(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, k=6, only=[1, 3, 5]))


def topk_batch(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, k=v.over_fetch(4)))


def relative_cutoff(spark, sf_dir):
    return _shown(v.relative_cutoff(_hits(spark, sf_dir), 0.3))


def token_budget_select(spark, sf_dir):
    return _shown(v.select_within_budget(_hits(spark, sf_dir), 4, 700))


def vector_norm_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", v.is_valid("embedding", 64).alias("valid"), F.round(v.norm("embedding"), 6).alias("norm"))


def vector_normalize(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", v.normalized("embedding").alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(v.norm("u"), 6).alias("norm"))


def cosine_pairwise_label(spark, sf_dir):
    """Mean cosine of each query with each knowledge base."""
    hits = v.scored(asked(spark, sf_dir, "vec_id % 20 = 0"), chunks(spark, sf_dir), -2.0)
    return hits.groupBy("query_id", F.col("kb_id").alias("label")).agg(F.round(F.avg("score"), 6).alias("mean_cosine"), F.count("*").alias("n"))


def _approximate(spark, sf_dir, k=10):
    rows = chunks(spark, sf_dir)
    centres = ix.fit(rows, k=k)
    return ix.search(asked(spark, sf_dir, "vec_id % 20 = 0"), ix.indexed(rows, centres), centres, k)


def ann_topk(spark, sf_dir):
    """The ten best by the approximate index."""
    return _shown(_approximate(spark, sf_dir))


def ann_recall(spark, sf_dir):
    """How many of the ten best of all queries the index finds, as a share of at least 0.9 or not."""
    exact = _hits(spark, sf_dir, min_score=-1.0, k=10).select("query_id", "chunk_id")
    both = exact.join(_approximate(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("n_best"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))


def _sql(where, only="", k=12, tail="select query_id, chunk_id, kb_id, round(score, 6) score from h"):
    dot = "list_inner_product(c.embedding::double[], q.embedding::double[])"
    n = "sqrt(list_inner_product({0}.embedding::double[], {0}.embedding::double[]))"
    return f"""
with s as (select q.vec_id query_id, c.vec_id chunk_id, c.label kb_id, {_TOKENS.replace('vec_id', 'c.vec_id')} token_count, {dot} / ({n.format('c')} * {n.format('q')}) score
  from embeddings c, embeddings q where {where} {only}),
h as (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from s where score >= 0.1 qualify r <= {k})
{tail}
"""


_BUDGET = """, recursive f as (
  select query_id, 1 r, 1 n, token_count tokens, chunk_id, kb_id, score, true took from h where r = 1
  union all select h.query_id, h.r, f.n + (ok)::int, f.tokens + case when ok then h.token_count else 0 end, h.chunk_id, h.kb_id, h.score, ok
  from (select h.*, f.n fn, f.tokens ft, f.n < 4 and f.tokens + h.token_count <= 700 ok from f join h on h.query_id = f.query_id and h.r = f.r + 1) h
  join f on f.query_id = h.query_id and f.r = h.r - 1)
select query_id, chunk_id, kb_id, round(score, 6) score from f where took"""
_MANY = "q.vec_id % 20 = 0"
QUERIES = {f.__name__: f for f in (topk_search, topk_search_filtered, topk_batch, relative_cutoff, token_budget_select, vector_norm_check, vector_normalize, cosine_pairwise_label, ann_topk, ann_recall)}
ORACLES = {
    "topk_search": _sql(_MANY, k=6),
    "topk_search_filtered": _sql(_MANY, "and c.label in (1, 3, 5)", 6),
    "topk_batch": _sql(_MANY),
    "relative_cutoff": _sql(_MANY, tail="select query_id, chunk_id, kb_id, round(score, 6) score from (select *, max(score) over (partition by query_id) best from h) where score >= best * 0.3"),
    "token_budget_select": _sql(_MANY, tail=_BUDGET).replace("\nwith s as", "\nwith recursive s as").replace(", recursive f as", ", f as"),
    "vector_norm_check": "select vec_id, len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) valid, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) norm from embeddings",
    "vector_normalize": """select vec_id, round(embedding[1]::double / n, 6) "first", round(embedding[64]::double / n, 6) "last", 1.0::double norm
from (select *, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings)""",
    "cosine_pairwise_label": """select q.vec_id query_id, c.label, round(avg(list_inner_product(c.embedding::double[], q.embedding::double[]) / sqrt(list_inner_product(c.embedding::double[], c.embedding::double[])
 * list_inner_product(q.embedding::double[], q.embedding::double[]))), 6) mean_cosine, count(*) n from embeddings c, embeddings q where q.vec_id % 20 = 0 group by all""",
    "ann_recall": "select cast(sum(least(10, n)) as bigint) n_best, true reached from (select (select count(*) from embeddings) n from embeddings where vec_id % 20 = 0)",
}
