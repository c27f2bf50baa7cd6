"""Whole-engine queries: extraction, crawling, batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.crawl import crawl
from ..session import shared_checkpoints
from ..sources.html import extracted
from ..sources.tables import spread, table
from . import engine

#: Hashed vectors of short questions and long chunks are far apart, so the floor is lower than for a trained embedder.
_CONFIG = EngineConfig(chunk_tokens=128, overlap_tokens=24, min_score=0.15, dimensions=256)


def html_extract(spark, sf_dir):
    x = extracted(table(spark, sf_dir, "pages"))
    return x.select("page_id", "title", F.size("headings").alias("n_headings"), F.size("paragraphs").alias("n_paragraphs"), F.size("links").alias("n_links"), "content_hash")


def crawl_bfs(spark, sf_dir):
    """A crawl over all pages of the table, linked as a tree: each page names page 2n + 2, then 2n + 1."""
    site, n = "https://site.example/p/", F.col("page_id")
    links = F.array(*[F.concat(F.lit("/p/"), (2 * n + k).cast("string")) for k in (2, 1)])
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit(site), "page_id").alias("url"), F.col("url").alias("title"), F.col("html").alias("text"), links.alias("links"))
    return spark.createDataFrame([(i, r.key, r.title) for i, r in enumerate(crawl(pages, site + "0", 8, 1))], "turn int, url string, title string")


def ask_batch(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("page_id"), F.col("source").alias("kb_id"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url"), F.col("source").alias("title"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    shared_checkpoints(spark)
    out = engine.ask(asked, engine.indexed(docs, _CONFIG).checkpoint(), _CONFIG)
    return out.select("question_id", "answer", "refusal", F.size("sources").alias("n_sources"), F.get("sources", F.lit(0))["url"].alias("best_url"))


#: Text of markup as the tables write it: tags go, the four references they use are resolved, white space is one blank.
_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""
#: A restatement for the pages of the tables alone: text stands in headings and paragraphs of one article, paragraphs may lack their end tag.
_EXTRACTED = f"""with p as (select page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) body from pages),
s as (select page_id, unnest(string_split(regexp_replace(body, '<(h1|p)>', chr(1) || '\\1>', 'g'), chr(1))[2:]) piece, unnest(range(0, len(string_split(regexp_replace(body, '<(h1|p)>', chr(1) || '\\1>', 'g'), chr(1))) - 1)) pos from p),
t as (select page_id, pos, starts_with(piece, 'h1>') heading, {_PLAIN.format("regexp_replace(piece, '^(h1|p)>', '')")} said from s),
u as (select * from t where said <> '' and (heading or length(said) >= 3) qualify row_number() over (partition by page_id, said order by pos) = 1),
g as (select page_id, count(*) filter (heading) h, count(*) filter (not heading) n, string_agg(case when heading then chr(10) || '## ' || said || chr(10) else said end, chr(10) order by pos) whole from u group by page_id)
select page_id, coalesce(nullif({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), url) title, cast(coalesce(h, 0) as int) n_headings, cast(coalesce(n, 0) as int) n_paragraphs,
  cast(len(regexp_extract_all(html, '<a href="[^"]+"')) as int) n_links, sha256(trim(regexp_replace(coalesce(whole, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')) content_hash
from p left join g using (page_id)"""
QUERIES = {f.__name__: f for f in (html_extract, crawl_bfs, ask_batch)}
ORACLES: dict[str, str] = {
    "html_extract": _EXTRACTED,
    "crawl_bfs": """with recursive t as (select 0::bigint id, [0] path union all select 2 * id + k, list_append(path, 2 - k) from t, (values (2), (1)) v(k) where len(path) < 6),
o as (select cast(row_number() over (order by len(path), path) - 1 as int) turn, page_id, url from t join pages on page_id = id where html <> '')
select turn, 'https://site.example/p/' || page_id url, url title from o where turn < 8"""
}
