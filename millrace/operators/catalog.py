"""The catalog of knowledge bases: statement shapes as DataFrame functions that return the new snapshot of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "indexing", "ready", "failed")
COLUMNS = ("id", "site_url", "site_title", "status", "error", "page_count", "chunk_count")
SCHEMA = "id string, site_url string, site_title string, status string, error string, page_count int, chunk_count int"
#: What a stored catalog has besides; the functions below keep these columns where a catalog has them.
TIMES = "created_at timestamp, updated_at timestamp, indexed_at timestamp"


def _touched(kbs: DataFrame, changed: Column, indexed: Column | None = None) -> DataFrame:
    """Rows that a statement changed get the present time as updated_at, new ones as created_at, and those that ``indexed`` names as indexed_at."""
    if "updated_at" not in kbs.columns:
        return kbs
    now = F.current_timestamp()
    kbs = kbs.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": F.when(changed, now).otherwise(F.coalesce("updated_at", now))})
    return kbs if indexed is None else kbs.withColumn("indexed_at", F.when(indexed, now).otherwise(F.col("indexed_at")))


def _times(kbs: DataFrame) -> list[str]:
    return [c for c in ("created_at", "updated_at", "indexed_at") if c in kbs.columns]


def upserted(kbs: DataFrame, new: DataFrame) -> DataFrame:
    """Insert sites by url; a known site takes the new title and goes back to indexing without error, keeping its id and counts. new: id, site_url, site_title."""
    n = new.groupBy("site_url").agg(F.min(F.struct("id", "site_title")).alias("n"))
    j = kbs.join(n, "site_url", "full")
    fresh = F.col("n").isNotNull()
    out = j.select(
        F.coalesce("id", "n.id").alias("id"), "site_url", F.when(fresh, F.col("n.site_title")).otherwise(F.col("site_title")).alias("site_title"), F.when(fresh, "indexing").otherwise(F.col("status")).alias("status"),
        F.when(~fresh, F.col("error")).alias("error"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        *_times(kbs), fresh.alias("_fresh"),
    )
    return _touched(out, F.col("_fresh")).drop("_fresh")


def marked_ready(kbs: DataFrame, kb_id: str, pages: int, chunks: int) -> DataFrame:
    one = F.col("id") == kb_id
    return _touched(kbs, one, one).withColumns({"status": F.when(one, "ready").otherwise(F.col("status")), "error": F.when(~one, F.col("error")), "page_count": F.when(one, pages).otherwise(F.col("page_count")), "chunk_count": F.when(one, chunks).otherwise(F.col("chunk_count"))})


def marked_failed(kbs: DataFrame, kb_id: str, message: str) -> DataFrame:
    one = F.col("id") == kb_id
    return _touched(kbs, one).withColumns({"status": F.when(one, "failed").otherwise(F.col("status")), "error": F.when(one, F.substring(F.lit(message), 1, 2000)).otherwise(F.col("error"))})


def recovered(kbs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sites left in indexing: ready with recounted pages and chunks if they have chunks, else failed."""
    n = chunks.groupBy("kb_id").agg(F.count("*").cast("int").alias("nc")).join(pages.groupBy("kb_id").agg(F.count("*").cast("int").alias("np")), "kb_id", "left").withColumnRenamed("kb_id", "id")
    j = kbs.join(n, "id", "left")
    stale, alive = F.col("status") == "indexing", F.col("nc") > 0
    out = j.select(
        "id", "site_url", "site_title", F.when(stale, F.when(alive, "ready").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(stale, F.when(~F.coalesce(alive, F.lit(False)), "indexing did not finish")).otherwise(F.col("error")).alias("error"),
        F.when(stale & alive, F.coalesce("np", F.lit(0))).otherwise(F.col("page_count")).alias("page_count"), F.when(stale & alive, F.col("nc")).otherwise(F.col("chunk_count")).alias("chunk_count"),
        *_times(kbs), stale.alias("_stale"),
    )
    return _touched(out, F.col("_stale")).drop("_stale")


def deleted(kbs: DataFrame, pages: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the sites of ``gone`` (id); pages and chunks go with their site."""
    keys = gone.select(F.col("id").alias("kb_id")).distinct()
    return kbs.join(keys.withColumnRenamed("kb_id", "id"), "id", "left_anti"), pages.join(keys, "kb_id", "left_anti"), chunks.join(keys, "kb_id", "left_anti")


def replaced(old: DataFrame, new: DataFrame, kb_id: str) -> DataFrame:
    """A child table with one site's rows replaced."""
    return old.where(F.col("kb_id") != kb_id).unionByName(new.where(F.col("kb_id") == kb_id))


def listed(kbs: DataFrame) -> DataFrame:
    """The catalog, the newest site first."""
    return kbs.orderBy(F.desc("created_at"), "site_url")


def stats(kbs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    one = kbs.agg(F.count_if(F.col("status") == "ready").alias("ready_sites"), F.count("*").alias("total_sites"))
    return one.crossJoin(pages.agg(F.count("*").alias("pages"))).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def violations(kbs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Broken rules and how often: unknown status, repeated site url, repeated page, repeated chunk, orphan page."""
    named = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    again = lambda df, *c: df.groupBy(*c).count().where("count > 1")
    out = named(kbs.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "status")
    for df, rule in ((again(kbs, "site_url"), "site_url"), (again(pages, "kb_id", "url"), "page"), (again(chunks, "page_id", "chunk_index"), "chunk"), (pages.join(kbs.select(F.col("id").alias("kb_id")), "kb_id", "left_anti"), "orphan_page")):
        out = out.unionByName(named(df, rule))
    return out


def next_status(status: str, event: str, chunks: int = 0) -> str:
    """The status after start, finish or fail; a failed re-index with surviving chunks stays ready."""
    if event == "start":
        return "indexing"
    if status != "indexing" or event not in ("finish", "fail"):
        raise ValueError(f"{event} is not possible in {status}")
    return "ready" if event == "finish" or chunks else "failed"
