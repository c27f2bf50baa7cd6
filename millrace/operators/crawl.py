"""Crawling over a stored link graph: breadth first, bounded by pages, in the order of one queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..session import shared_checkpoints

LEAST_CHARS, FRONTIER_FACTOR = 120, 12


def crawl(pages: DataFrame, start_url: str, max_pages: int = 8, least_chars: int = LEAST_CHARS) -> list:
    """The usable pages that a crawl from ``start_url`` reaches, in order, as rows of url, title and text.

    ``pages`` are extracted pages (url, title, text, links); of several with one canonical url the smallest row counts. Pages are taken from one queue: a page's links go to its end, those beside the
    start before others, each in the order of the page; links already queued or taken are passed over, and none is added while queue and results hold over 12 times max_pages.
    An error if no page is usable. A level takes a job for its pages and, but for the last, one for its links; the pages and, of each page, as many new links as the queue could take reach the driver, so both are bounded by that factor.
    """
    spark = pages.sparkSession
    shared_checkpoints(spark)
    start = spark.range(1).select(u.normalized(F.lit(start_url)).alias("key"), u.path(F.lit(start_url)).alias("path"), u.origin(F.lit(start_url)).alias("origin")).first()
    most = max_pages * FRONTIER_FACTOR
    here = pages.where(u.origin(F.col("url")) == start.origin).select(u.normalized(F.col("url")).alias("key"), "url", "title", "text", "links")
    known = here.groupBy("key").agg(F.min(F.struct("url", "title", "text", "links")).alias("page")).select("key", "page.*").checkpoint()
    level, taken, found = [start.key], set(), []
    while level and max_pages > 0:
        asked = spark.createDataFrame([(k,) for k in level], "key string")
        passed = spark.createDataFrame([(k,) for k in taken | set(level)], "target string")
        now = known.join(F.broadcast(asked), "key").withColumn("ok", (F.length("text") >= least_chars) & ~u.is_disambiguation(F.col("title"), F.col("text")))
        usable = {r.key: r for r in now.where("ok").select("key", "url", "title", "text").collect()}
        if len(found) + len(usable) >= max_pages:
            found += [usable[key] for key in level if key in usable][: max_pages - len(found)]
            break
        links = now.select("key", "url", F.posexplode("links").alias("pos", "href")).select("key", "pos", u.eligible(F.col("href"), F.col("url"), F.lit(start.path)).alias("target")).where("target is not null")
        fresh = links.groupBy("key", "target").agg(F.min("pos").alias("pos")).join(F.broadcast(passed), "target", "left_anti")
        order = Window.partitionBy("key").orderBy(~u.is_sibling(F.col("target"), F.lit(start.path)), "pos")
        ahead: dict[str, list[str]] = {}
        for r in fresh.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most + 1).orderBy("key", "turn").collect():
            ahead.setdefault(r.key, []).append(r.target)
        waiting, following = len(level), []
        for key in level:
            waiting -= 1
            taken.add(key)
            if key in usable:
                found.append(usable[key])
            queued = set(following)
            for target in ahead.get(key, ()):
                if waiting + len(following) + len(found) > most:
                    break
                if target not in queued:
                    following.append(target)
        level = following
    if not found:
        raise ValueError(f"no readable page under {start_url}")
    return found
