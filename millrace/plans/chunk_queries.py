"""Chunking queries over documents; the digest columns keep results narrow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import duck, duck_tokens, duck_trimmed, exploded, tokens, trimmed, truncated
from ..operators import chunk, clean, passages
from ..sources.tables import spread, table

CHUNK, OVERLAP = 128, 24


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("n_tokens"), F.sha2(truncated(F.col("text"), 200), 256).alias("head_sha256"))


def sentence_split(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = F.expr(f"filter(transform(regexp_extract_all(line, {chunk.lit(chunk.SENTENCE)}, 0), s -> {trimmed('s')}), s -> s <> '')")
    return lines.select("doc_id", "line_no", F.size(found).alias("n_sentences"), F.sha2(F.array_join(found, "\n"), 256).alias("sentences_sha256"))


def build_units(spark, sf_dir):
    u = exploded(_docs(spark, sf_dir), ["doc_id"], F.expr(chunk.units("text", CHUNK)), "unit_no", "u")
    return u.select("doc_id", "unit_no", F.col("u.n").alias("n_tokens"), F.sha2("u.t", 256).alias("unit_sha256"))


def chunk_pack(spark, sf_dir):
    c = exploded(chunk.with_chunks(_docs(spark, sf_dir), "text", CHUNK, OVERLAP), ["doc_id"], "chunks", "i", "c")
    return c.select("doc_id", "i", F.col("c.tokens").alias("tokens"), F.sha2("c.text", 256).alias("text_sha256"))


def _per_doc(expr, name):
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", F.expr(expr).alias(name))

    return run


def listing_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.expr(chunk.is_listing("line")).alias("is_listing"))


def _built(spark, sf_dir):
    return passages.built(_docs(spark, sf_dir), ["doc_id"], chunk_tokens=CHUNK, overlap_tokens=OVERLAP)


def build_chunks(spark, sf_dir):
    return _built(spark, sf_dir).select("doc_id", "chunk_index", "token_count", F.sha2("text", 256).alias("text_sha256"))


def chunk_cap_reindex(spark, sf_dir):
    """The first 500 chunks of each source, pages renumbered."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    built = passages.built(docs, ["doc_id", "source"], chunk_tokens=CHUNK, overlap_tokens=OVERLAP, texts=False)
    return chunk.capped(built, 500, kb_col="source").select("source", "doc_id", "page_index", "chunk_index", "token_count")


_FOLD = chunk.oracle_chunks("src", CHUNK, OVERLAP)
_PACK = f"with recursive src as (select doc_id, text from documents where text is not null), {_FOLD} select doc_id, i, tokens, sha256(text) text_sha256 from kk"
_REFINED = f"""
, r as (select doc_id, i, {chunk.duck_without_listings('t0')} t from (select *, {chunk.duck_without_labels('text')} t0 from kk where {chunk.duck_has_prose('text')})),
b as (select doc_id, row_number() over (partition by doc_id order by i) - 1 chunk_index, t, {duck_tokens('t')} token_count from r
  where t <> '' and (regexp_matches(t, {duck(chunk.TERMINAL)}) or {duck_tokens('t')} >= 8))
"""
_BUILT = clean.oracle_cleaned().replace("\nwith s as", "\nwith recursive s as", 1) + f", src as (select doc_id, cleaned as text from c where cleaned <> ''), {_FOLD.replace('k as (select', 'k as (select', 1)}" + _REFINED
_LINES = "with e as (select doc_id, string_split(text, chr(10)) ls from documents), l as (select doc_id, unnest(ls) line, cast(unnest(range(0, len(ls))) as int) line_no from e) "
_SENT = f"list_filter(list_transform(regexp_extract_all(line, {duck(chunk.SENTENCE)}), lambda s: {duck_trimmed('s')}), lambda s: s <> '')"
_HEAD = rf"regexp_extract(text, '(?s)^(?:[{chunk.WS}]*(?:{chunk.TOKEN})){{{{0,200}}}}')".replace("{{", "{").replace("}}", "}")
QUERIES = {
    "token_count": token_count, "sentence_split": sentence_split, "build_units": build_units, "chunk_pack": chunk_pack, "listing_lines": listing_lines,
    "prose_filter": _per_doc(chunk.has_prose("text"), "has_prose"), "trim_labels": _per_doc(f"sha2({chunk.without_leading_labels('text')}, 256)", "trimmed_sha256"),
    "strip_listings": _per_doc(f"sha2({chunk.without_listing_lines('text')}, 256)", "stripped_sha256"), "build_chunks": build_chunks, "chunk_cap_reindex": chunk_cap_reindex,
}
ORACLES = {
    "token_count": f"select doc_id, {duck_tokens('text')} n_tokens, sha256(case when {duck_tokens('text')} > 200 then {_HEAD} else text end) head_sha256 from documents",
    "sentence_split": _LINES + f"select doc_id, line_no, len({_SENT}) n_sentences, sha256(array_to_string({_SENT}, chr(10))) sentences_sha256 from l",
    "build_units": f"with u as (select doc_id, {chunk.duck_units('text', CHUNK)} us from documents), e as (select doc_id, unnest(us) x, cast(unnest(range(0, len(us))) as int) unit_no from u) select doc_id, unit_no, x.n n_tokens, sha256(x.t) unit_sha256 from e",
    "chunk_pack": _PACK,
    "listing_lines": _LINES + f"select doc_id, line_no, {chunk.duck_listing('line')} is_listing from l",
    "prose_filter": f"select doc_id, {chunk.duck_has_prose('text')} has_prose from documents",
    "trim_labels": f"select doc_id, sha256({chunk.duck_without_labels('text')}) trimmed_sha256 from documents",
    "strip_listings": f"select doc_id, sha256({chunk.duck_without_listings('text')}) stripped_sha256 from documents",
    "build_chunks": _BUILT + "select doc_id, chunk_index, token_count, sha256(t) text_sha256 from b",
    "chunk_cap_reindex": _BUILT + ", g as (select d.source, b.*, row_number() over (partition by d.source order by b.doc_id, chunk_index) n, dense_rank() over (partition by d.source order by b.doc_id) - 1 page_index from b join documents d using (doc_id)) select source, doc_id, page_index, chunk_index, token_count from g where n <= 500",
}
