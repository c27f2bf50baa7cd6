"""Url and link queries over pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.text import duck
from ..sources.tables import table

_HREF = '<a href="([^"]*)"'


def _links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("pos", "href")).where("href <> ''")


def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.normalized(F.col("url")).alias("normalized"))


def link_harvest(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href")


def link_filter(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", u.eligible(F.col("href"), F.col("url"), u.path(F.col("url"))).alias("target")).where("target is not null")


def sibling_order(spark, sf_dir):
    """Each page's links in crawl order: those beside the page first, at most 96."""
    e = _links(spark, sf_dir).select("page_id", "pos", u.eligible(F.col("href"), F.col("url"), u.path(F.col("url"))).alias("target"), u.is_sibling(u.absolute(F.col("href"), F.col("url")), u.path(F.col("url"))).alias("sibling"))
    best = Window.partitionBy("page_id").orderBy(F.desc("sibling"), "pos")
    return e.where("target is not null").withColumn("turn", F.row_number().over(best)).where("turn <= 96").select("page_id", "target", "sibling", "turn")


def parse_user_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.parsed_input(F.regexp_replace("url", "^https?://", "")).alias("parsed"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def disambiguation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", u.is_disambiguation(F.col("source"), F.col("text")).alias("is_disambiguation"), (F.length("text") >= 120).alias("long_enough"))


def redirect_dedup(spark, sf_dir):
    """One page per canonical url, the first by id."""
    return table(spark, sf_dir, "pages").groupBy(u.normalized(F.col("url")).alias("normalized")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))


_TRACK = ", ".join(f"'{t}'" for t in u.TRACKING)


def _norm(x: str) -> str:
    o, q = f"regexp_extract({x}, '^https?://[^/?#]+')", f"regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1)"
    p = f"case when regexp_extract({x}, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract({x}, '^https?://[^/?#]+([^?#]*)', 1) end"
    p = f"array_to_string(list_transform(string_split({p}, ''), lambda c: case when unicode(c) between 33 and 126 then c else url_encode(c) end), '')"
    kept = f"list_transform(list_sort(list_filter(string_split({q}, '&'), lambda p: p <> '' and string_split(p, '=')[1] not in ({_TRACK}))), lambda p: case when contains(p, '=') then p else p || '=' end)"
    whole = f"(lower({o}) || ({p}) || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end)"
    return f"case when ends_with({whole}, '/') and ({p}) <> '/' then {whole}[:-2] else {whole} end"


_E = f"""
with p as (select page_id, url, regexp_extract(url, '^https?://[^/?#]+') o, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) sp, regexp_extract_all(html, '{_HREF}', 1) hs from pages),
x as (select page_id, url, o, sp, unnest(hs) href, cast(unnest(range(0, len(hs))) as int) pos from p),
l as (select *, o || href t, regexp_extract(href, '^[^?#]*') path from x where href <> ''),
e as (select *, path = sp or not (regexp_matches(path, {duck(u.WIKI_META)}) or regexp_matches(path, {duck(u.UTILITY)}) or path = '/' or regexp_matches(path, {duck(u.LANDING)}) or regexp_matches(path, {duck(u.DISAMBIGUATION)})) ok from l
  where starts_with(href, '/') and not regexp_matches(path, {duck(u.SKIP_EXTENSION)})),
f as (select page_id, pos, {_norm('t')} target, length(regexp_extract(sp, '^.*/')) > 1 and starts_with(path, regexp_extract(sp, '^.*/')) sibling from e where ok)
"""
QUERIES = {f.__name__: f for f in (url_normalize, link_harvest, link_filter, sibling_order, parse_user_url, content_hash, disambiguation, redirect_dedup)}
ORACLES = {
    "url_normalize": f"select page_id, {_norm('url')} normalized from pages",
    "link_harvest": _E + "select page_id, pos, href from x where href <> ''",
    "link_filter": _E + "select page_id, pos, target from f",
    "sibling_order": _E + "select page_id, target, sibling, cast(row_number() over (partition by page_id order by sibling desc, pos) as int) turn from f qualify turn <= 96",
    "parse_user_url": "select page_id, 'https://' || regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') parsed from pages",
    "content_hash": "select doc_id, sha256(text) content_hash from documents",
    "disambiguation": r"""select doc_id, regexp_matches(source, '(?i)\(disambiguation\)') or regexp_matches(text, '(?i)this disambiguation page lists articles|topics referred to by the same term')
 or (regexp_matches(text[:400], '(?i)\bmay (?:refer|also refer) to\b') and length(text) < 4000) is_disambiguation, length(text) >= 120 long_enough from documents""",
    "redirect_dedup": f"select {_norm('url')} normalized, min(page_id) page_id, count(*) n_pages from pages group by 1",
}
