"""Catalog queries: customers stand for sites, orders for pages and line items for chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as k
from ..sources.tables import table


#: Line items that a task joins and groups; a table of more is dealt into as many tasks as that takes, so a task's memory does not grow with the table.
ROWS_A_TASK = 1_000_000


def kbs_and_pages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("https://"), "c_name").alias("site_url"), F.col("c_name").alias("site_title"),
        F.when(F.col("c_mktsegment") == "BUILDING", "indexing").when(F.col("c_mktsegment") == "MACHINERY", "failed").otherwise("ready").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(0).alias("page_count"), F.lit(0).alias("chunk_count"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").cast("string").alias("kb_id"), F.col("o_orderpriority").alias("url"), F.col("o_orderdate").alias("scraped_at"))
    return c, o


def tables(spark, sf_dir):
    c, o = kbs_and_pages(spark, sf_dir)
    li, own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("chunk_index")), o.select("page_id", "kb_id")
    if (n := li.count()) > ROWS_A_TASK:  # without a stated number, adaptive execution merges partitions again
        parts = max(-(-n // ROWS_A_TASK), spark.sparkContext.defaultParallelism)
        li, own = li.repartition(parts, "page_id"), own.repartition(parts, "page_id")
    return c, o, li.join(own, "page_id")


def upsert_catalog(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("https://Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("site_url"), F.col("s_name").alias("site_title"))
    return k.upserted(kbs_and_pages(spark, sf_dir)[0], s)


def stale_recovery(spark, sf_dir):
    return k.recovered(*tables(spark, sf_dir))


def cascade_delete(spark, sf_dir):
    c, o, li = tables(spark, sf_dir)
    kbs, pages, chunks = k.deleted(c, o, li, c.where("status = 'failed'"))
    return k.stats(kbs, pages, chunks)


def corpus_stats(spark, sf_dir):
    return k.stats(*tables(spark, sf_dir))


def list_sites(spark, sf_dir):
    return kbs_and_pages(spark, sf_dir)[0].select("id", "site_url", "status").orderBy(F.desc("site_url"))


def site_by_url(spark, sf_dir):
    return kbs_and_pages(spark, sf_dir)[0].where(F.col("site_url") == "https://Customer#000000007").select("id", "site_url", "status")


def list_pages(spark, sf_dir):
    return kbs_and_pages(spark, sf_dir)[1].where("kb_id = '7'").orderBy("scraped_at", "page_id").select("page_id", "url", F.col("scraped_at").cast("string").alias("scraped_at"))


def count_by_kb(spark, sf_dir):
    return tables(spark, sf_dir)[2].groupBy("kb_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("page_id").alias("n_pages"))


def constraint_violations(spark, sf_dir):
    return k.violations(*tables(spark, sf_dir))


def mark_states(spark, sf_dir):
    c = k.marked_failed(k.marked_ready(kbs_and_pages(spark, sf_dir)[0], "1", 3, 9), "2", "x" * 3000)
    return c.select("id", "status", F.length("error").alias("error_chars"), "page_count", "chunk_count")


def replace_content(spark, sf_dir):
    pages = kbs_and_pages(spark, sf_dir)[1].select("page_id", "kb_id")
    return k.replaced(pages, pages.where("kb_id = '7'").select((F.col("page_id") + 1_000_000_000).alias("page_id"), "kb_id"), "7").groupBy("kb_id").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


_T = """with c as (select c_custkey::varchar id, 'https://' || c_name site_url, c_name site_title, case when c_mktsegment = 'BUILDING' then 'indexing' when c_mktsegment = 'MACHINERY' then 'failed' else 'ready' end status,
 null::varchar error, 0 page_count, 0 chunk_count from customer),
o as (select o_orderkey page_id, o_custkey::varchar kb_id, o_orderpriority url, o_orderdate scraped_at from orders), li as (select page_id, kb_id, l_linenumber chunk_index from lineitem join o on l_orderkey = page_id)
"""
_STATS = "select (select count(*) from {0} where status = 'ready') ready_sites, (select count(*) from {0}) total_sites, (select count(*) from {1}) pages, (select count(*) from {2}) chunks"
QUERIES = {f.__name__: f for f in (upsert_catalog, stale_recovery, cascade_delete, corpus_stats, list_sites, site_by_url, list_pages, count_by_kb, constraint_violations, mark_states, replace_content)}
ORACLES = {
    "upsert_catalog": _T + """, s as (select 's' || s_suppkey id, 'https://Customer#' || lpad(s_suppkey::varchar, 9, '0') site_url, s_name site_title from supplier)
select coalesce(c.id, s.id) id, coalesce(c.site_url, s.site_url) site_url, coalesce(s.site_title, c.site_title) site_title, case when s.id is not null then 'indexing' else status end status, error,
 coalesce(page_count, 0) page_count, coalesce(chunk_count, 0) chunk_count from c full join s on c.site_url = s.site_url""",
    "stale_recovery": _T + """select id, site_url, site_title, case when status <> 'indexing' then status when nc > 0 then 'ready' else 'failed' end status, case when status = 'indexing' and nc = 0 then 'indexing did not finish' end error,
 case when status = 'indexing' and nc > 0 then np::int else page_count end page_count, case when status = 'indexing' and nc > 0 then nc::int else chunk_count end chunk_count
from (select *, (select count(*) from li where kb_id = c.id) nc, (select count(*) from o where kb_id = c.id) np from c)""",
    "cascade_delete": _T + """, g as (select id from c where status = 'failed'), c2 as (select * from c where id not in (select id from g)), o2 as (select * from o where kb_id not in (select id from g)),
l2 as (select * from li where kb_id not in (select id from g)) """ + _STATS.format("c2", "o2", "l2"),
    "corpus_stats": _T + _STATS.format("c", "o", "li"),
    "list_sites": _T + "select id, site_url, status from c order by site_url desc",
    "site_by_url": _T + "select id, site_url, status from c where site_url = 'https://Customer#000000007'",
    "list_pages": _T + "select page_id, url, scraped_at::varchar scraped_at from o where kb_id = '7' order by scraped_at, page_id",
    "count_by_kb": _T + "select kb_id, count(*) n_chunks, count(distinct page_id) n_pages from li group by 1",
    "constraint_violations": _T + """select 'status' "rule", count(*) n from c where status not in ('pending', 'indexing', 'ready', 'failed') union all select 'site_url', count(*) from (select 1 from c group by site_url having count(*) > 1)
union all select 'page', count(*) from (select 1 from o group by kb_id, url having count(*) > 1) union all select 'chunk', count(*) from (select 1 from li group by page_id, chunk_index having count(*) > 1)
union all select 'orphan_page', count(*) from o where kb_id not in (select id from c)""",
    "mark_states": _T + "select id, case id when '1' then 'ready' when '2' then 'failed' else status end status, case id when '2' then 2000 end error_chars, case id when '1' then 3 else 0 end page_count, case id when '1' then 9 else 0 end chunk_count from c",
    "replace_content": _T + "select kb_id, count(*) n, min(case when kb_id = '7' then page_id + 1000000000 else page_id end) \"first\" from o group by 1",
}
