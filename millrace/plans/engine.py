"""The engine: index pages into a corpus, ask batches of questions, keep the catalog. Tables are folders behind numbered manifests."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import urls
from ..functions.text import tokens, truncated
from ..operators import answer, catalog, chunk, ground, vectors
from ..operators.crawl import crawl
from ..operators.embed import embedded
from ..operators.passages import built
from ..sources.html import extracted


def indexed(pages: DataFrame, config: EngineConfig, page_col: str = "page_id", kb_col: str = "kb_id") -> DataFrame:
    """Chunks of pages (page, kb, url, title, text): page, kb, url, title, chunk_index, chunk_id, content, token_count, embedding. Nothing is shuffled."""
    df = built(pages, [page_col, kb_col, "url", "title"], "text", config.chunk_tokens, config.overlap_tokens)
    df = df.select(page_col, kb_col, "url", "title", "chunk_index", F.concat_ws(":", page_col, "chunk_index").alias("chunk_id"), F.col("text").alias("content"), "token_count")
    return df.withColumn("embedding", embedded("content", config.dimensions)).where("embedding is not null")


def extractive(question, passages, long, messages):
    """A generator without a model: the first sentences of the passages, best passage first, that hold a term of the question. A generator with a model would use ``messages``."""
    words = ground.terms(question)
    sentences = F.flatten(F.transform(passages, lambda p: F.regexp_extract_all(p, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))))
    hits = F.filter(sentences, lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w)))
    return F.array_join(F.slice(F.transform(hits, lambda s: F.trim(s)), F.lit(1), F.when(long, 12).otherwise(3)), " ")


_SOURCES = "cast(array() as array<struct<url: string, title: string, site_title: string, score: double>>)"


def ask(questions: DataFrame, chunks: DataFrame, config: EngineConfig, history: DataFrame | None = None, corpus: DataFrame | None = None, generator: Callable = extractive) -> DataFrame:
    """Answers to a batch: question_id, answer, refusal, sources (array of url, title, site_title and score, best first).

    questions: question_id, question; chunks as ``indexed`` gives them, with a site_title or without. history (question_id, turn, role, text): a question without terms of its own is searched with the last
    user text that has some, and the prompt holds the last turns. corpus (content): what a term must be absent from for a refusal, by default the chunks. generator gives the raw answer
    from columns of question, passages, whether a long answer is asked for, and prompt messages; it is cut at stop strings and at the mode's token cap. Refused questions keep their row.
    """
    if "site_title" not in chunks.columns:
        chunks = chunks.withColumn("site_title", F.lit(None).cast("string"))
    asked = questions.select("question_id", "question")
    turns_type = "array<struct<role: string, content: string>>"
    if history is not None:
        last = asked.select("question_id", F.lit(1 << 40).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"))
        turns = history.select("question_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(last)
        recent = history.where(F.col("role").isin("user", "assistant")).withColumn("back", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("turn")))).where("back <= 6")
        recent = recent.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).alias("ts"))
        recent = recent.select("question_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("history"))
        asked = asked.join(ground.resolved(turns, "question_id").where(F.col("turn") == (1 << 40)).select("question_id", "query"), "question_id").join(recent, "question_id", "left")
        asked = asked.withColumn("history", F.coalesce("history", F.expr(f"cast(array() as {turns_type})")))
    else:
        asked = asked.withColumns({"query": F.col("question"), "history": F.expr(f"cast(array() as {turns_type})")})
    asked = asked.withColumns({"long": ground.wants_long(F.col("question")), "mode": ground.parameters(F.col("question"), config.top_k, config.max_tokens, config.max_tokens_long, config.min_score)})
    short = asked.withColumn("query", truncated(F.col("query"), config.embed_tokens))
    vec = short.select("question_id", embedded("query", config.dimensions).alias("query")).where("query is not null").withColumnRenamed("question_id", "query_id")
    pool = chunks.select("chunk_id", "kb_id", "token_count", "embedding")
    fetched = vectors.over_fetch(max(2 * config.top_k, 6))
    found = vectors.top_k(vectors.scored(vec, pool, config.min_score, most=fetched), fetched)
    modes = asked.select(F.col("question_id").alias("query_id"), "mode.k", "mode.max_tokens")
    found = found.join(modes, "query_id").where(F.col("rank") <= F.greatest(3 * F.col("k"), F.lit(12)))
    kept = vectors.select_within_budget(vectors.relative_cutoff(found, config.relative_cutoff), k_col="k", tokens_col="max_tokens")
    hits = kept.join(chunks.select("chunk_id", "content", "url", "title", "site_title"), "chunk_id").withColumnRenamed("query_id", "question_id")
    passages = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "title", "site_title", "url", "score"))).alias("hits"))
    met = asked.join(passages, "question_id", "left")
    haystack = F.lower(F.array_join(F.transform("hits", lambda h: F.concat_ws(" ", h["content"], h["title"], h["site_title"])), " "))
    everywhere = (chunks if corpus is None else corpus).select(F.col("content").alias("text"))
    gated = ground.gate(met.where("hits is not null").select("question_id", F.col("query").alias("question"), haystack.alias("haystack")), everywhere, config.min_term_ratio)
    met = met.join(gated.select("question_id", "grounded"), "question_id", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    texts = F.transform("hits", lambda h: h["content"])
    raw = generator(F.col("query"), texts, F.col("long"), answer.messages(F.col("question"), texts, F.col("history"), F.col("long")))
    cut = F.when(F.col("long"), truncated(answer.stopped(F.col("raw"), answer.STOPS_LONG), answer.ANSWER_TOKENS_LONG)).otherwise(truncated(answer.stopped(F.col("raw")), answer.ANSWER_TOKENS))
    met = met.withColumn("raw", F.when(F.col("grounded"), raw)).withColumn("raw", cut)
    met = met.withColumn("raw", F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", answer.REFUSAL).otherwise(F.col("raw"))).withColumn("refusal", answer.is_refusal(F.col("raw")))
    pages = F.array_distinct(F.transform("hits", lambda h: h["url"]))
    best = F.transform(pages, lambda u: F.array_sort(F.transform(F.filter("hits", lambda h: h["url"].eqNullSafe(u)), lambda h: F.struct((-h["score"]).alias("s"), h["url"].alias("url"), h["title"].alias("title"), h["site_title"].alias("site_title"))))[0])
    rolled = F.transform(F.array_sort(best), lambda b: F.struct(b["url"].alias("url"), b["title"].alias("title"), b["site_title"].alias("site_title"), F.round(-b["s"], 3).alias("score")))
    sources = F.when(F.col("refusal"), F.expr(_SOURCES)).otherwise(rolled)
    return met.select("question_id", F.when(F.col("refusal"), answer.REFUSAL).otherwise(answer.tidied("raw")).alias("answer"), "refusal", sources.alias("sources"))


class Engine:
    """A corpus store: the catalog, and each site's pages and chunks, under one folder that all executors share.

    Every write makes new table folders and then a manifest of the next number, put in place by one rename: a reader takes the newest manifest and sees all of a write or nothing,
    and a crash at any point leaves the one before. Indexing or deleting a site touches no other site's folders. Two writers at once are told apart by the number, and the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or EngineConfig()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The newest number and what it says; 0 and empty tables before the first write."""
        at = self._path(self.folder)
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        newest = max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)
        if not newest:
            return 0, {"kbs": None, "pages": {}, "chunks": {}}
        return newest, json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest-{newest}.json").collect()))

    def _publish(self, number: int, manifest: dict) -> None:
        part, at = self._path(f"{self.folder}/part-{uuid.uuid4().hex}.json"), self._path(f"{self.folder}/manifest-{number}.json")
        out = self._fs.create(part, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(at) or not self._fs.rename(part, at):
            raise RuntimeError("another writer was faster; read again and repeat")

    def _put(self, name: str, df: DataFrame) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{at}")
        return at

    def read(self, name: str, kb_id: str | None = None) -> DataFrame | None:
        """One of kbs, pages and chunks, of one site or all; None without any."""
        at = self._manifest()[1][name]
        folders = [at] if isinstance(at, str) else [v for k, v in (at or {}).items() if kb_id in (None, k)]
        return self.spark.read.parquet(*[f"{self.folder}/{x}" for x in folders]) if folders else None

    def _catalog(self) -> DataFrame:
        kbs = self.read("kbs")
        return kbs if kbs is not None else self.spark.createDataFrame([], f"{catalog.SCHEMA}, {catalog.TIMES}")

    def _save(self, kbs: DataFrame, change: Callable[[dict], None] = lambda m: None) -> None:
        number, manifest = self._manifest()
        manifest["kbs"] = self._put("kbs", kbs.coalesce(1))
        change(manifest)
        self._publish(number + 1, manifest)

    def index(self, site_url: str, pages: DataFrame, use_cache: bool = True, resume: bool = False) -> str:
        """Index one site's pages (page_id, url, title, text); returns the status.

        A ready site is left alone when ``use_cache``; one that is being indexed is refused unless ``resume``; new sites count against max_sites. Chunks of pages whose url, id and
        content are as before are kept, not made again. If nothing can be indexed, or making the chunks fails, a site with chunks stays ready with those, and another one is failed.
        """
        kbs = self._catalog()
        known = kbs.where(F.col("site_url") == site_url).first()
        if known and known.status == "ready" and use_cache:
            return "ready"
        if known and known.status == "indexing" and not resume:
            raise ValueError(f"{site_url} is being indexed")
        if not known and kbs.count() >= self.config.max_sites:
            raise ValueError(f"at most {self.config.max_sites} sites")
        kb_id, title = known.id if known else uuid.uuid4().hex, site_url.split("/")[2]
        self._save(catalog.upserted(kbs, self.spark.createDataFrame([(kb_id, site_url, title)], "id string, site_url string, site_title string")))
        try:
            made = self._chunks_of(kb_id, pages)
        except Exception as broken:
            self._failed(kb_id, str(broken))
            raise
        n = self.spark.read.parquet(f"{self.folder}/{made}").count()
        if not n:
            return self._failed(kb_id, "no readable content")
        chunks = self.spark.read.parquet(f"{self.folder}/{made}")
        kept = self._page_rows(kb_id, pages).join(chunks.select("page_id").distinct(), "page_id", "left_semi")
        stored = self._put("pages", kept)
        m = self.spark.read.parquet(f"{self.folder}/{stored}").count()
        self._save(catalog.marked_ready(self._catalog(), kb_id, m, n), lambda x: (x["pages"].update({kb_id: stored}), x["chunks"].update({kb_id: made})))
        return "ready"

    def _page_rows(self, kb_id: str, pages: DataFrame) -> DataFrame:
        text = F.col("text")
        return pages.select("page_id", F.lit(kb_id).alias("kb_id"), "url", "title", "text", F.sha2(text, 256).alias("content_hash"), F.length(text).alias("char_count"), tokens(text).alias("token_count"), F.current_timestamp().alias("scraped_at"))

    def _chunks_of(self, kb_id: str, pages: DataFrame) -> str:
        """Write the site's chunks once, taking over those of unchanged pages; the folder."""
        rows, old_pages, old = self._page_rows(kb_id, pages), self.read("pages", kb_id), self.read("chunks", kb_id)
        if old_pages is None or old is None:
            made = indexed(rows, self.config).withColumn("created_at", F.current_timestamp())
        else:
            same = rows.select("page_id", "url", "title", "content_hash").join(old_pages.select("page_id", "url", "title", "content_hash"), ["page_id", "url", "title", "content_hash"], "left_semi").select("page_id")
            made = indexed(rows.join(same, "page_id", "left_anti"), self.config).withColumn("created_at", F.current_timestamp()).unionByName(old.join(same, "page_id", "left_semi"), allowMissingColumns=True)
        if self.config.max_chunks_per_site:
            made = chunk.capped(made, self.config.max_chunks_per_site, "page_id").drop("page_index")
        return self._put("chunks", made)

    def _failed(self, kb_id: str, message: str) -> str:
        kept = self.read("chunks", kb_id)
        n = kept.count() if kept is not None else 0
        status = catalog.next_status("indexing", "fail", n)
        self._save(catalog.marked_ready(self._catalog(), kb_id, self.read("pages", kb_id).count(), n) if n else catalog.marked_failed(self._catalog(), kb_id, message))
        return status

    def index_stored(self, start_url: str, raw: DataFrame, max_pages: int | None = None, **how) -> str:
        """Crawl stored raw pages (page_id, url, html) from a user's url and index what is reached, within the page limit."""
        start = self.spark.range(1).select(urls.parsed_input(F.lit(start_url)).alias("u"), urls.origin(urls.parsed_input(F.lit(start_url))).alias("o")).first()
        if not start.u:
            raise ValueError(f"no url: {start_url}")
        found = crawl(extracted(raw.where(urls.origin(F.col("url")) == start.o)), start.u, self.config.page_limit(max_pages), self.config.least_chars)
        rows = self.spark.createDataFrame([(i, r.url, r.title, r.text) for i, r in enumerate(found)], "page_id long, url string, title string, text string")
        return self.index(start.u, rows, **how)

    def reindex(self, pages_of: Callable[[str], DataFrame], site_url: str | None = None) -> dict[str, str]:
        """Index one site or all again, also such as were cut off; each site's status. ``pages_of`` gives a site's pages."""
        sites = [r.site_url for r in self._catalog().where(F.lit(site_url is None) | (F.col("site_url") == site_url)).orderBy("site_url").collect()]
        return {s: self.index(s, pages_of(s), use_cache=False, resume=True) for s in sites}

    def ask(self, questions: DataFrame, history: DataFrame | None = None, **more) -> DataFrame:
        """Answers from all ready sites; a subject counts as covered if any site names it. Without a ready site, every question is refused."""
        chunks = self.read("chunks")
        if chunks is None:
            return questions.select("question_id", F.lit(answer.REFUSAL).alias("answer"), F.lit(True).alias("refusal"), F.expr(_SOURCES).alias("sources"))
        ready = self._catalog().where("status = 'ready'").select(F.col("id").alias("kb_id"), "site_title")
        return ask(questions, chunks.join(F.broadcast(ready), "kb_id"), self.config, history, corpus=chunks, **more)

    def open(self) -> None:
        """Repair sites whose indexing was cut off."""
        kbs, pages, chunks = self._catalog(), self.read("pages"), self.read("chunks")
        if kbs.where("status = 'indexing'").count():
            none = self.spark.createDataFrame([], "kb_id string")
            self._save(catalog.recovered(kbs, none if pages is None else pages, none if chunks is None else chunks))

    def delete(self, site_url: str) -> None:
        gone = [r.id for r in self._catalog().where(F.col("site_url") == site_url).collect()]
        if gone:
            self._save(self._catalog().where(~F.col("id").isin(gone)), lambda m: [m[t].pop(k, None) for t in ("pages", "chunks") for k in gone])

    def sites(self) -> DataFrame:
        """The catalog, the newest site first."""
        return catalog.listed(self._catalog())

    def stats(self) -> DataFrame:
        none = self.spark.createDataFrame([], "kb_id string")
        pages, chunks = self.read("pages"), self.read("chunks")
        return catalog.stats(self._catalog(), none if pages is None else pages, none if chunks is None else chunks)

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """A parameterised statement (:name) over the stored tables {kbs}, {pages} and {chunks}."""
        here = {name: df for name in ("kbs", "pages", "chunks") if f"{{{name}}}" in sql and (df := self._catalog() if name == "kbs" else self.read(name)) is not None}
        return self.spark.sql(sql, args=args or {}, **here)

    def query_one(self, sql: str, args: dict | None = None):
        """The first row, or None."""
        return self.query(sql, args).first()

    def check(self) -> dict[str, list[str] | None]:
        """The columns of each stored table; None where there is none."""
        return {name: None if (df := self.read(name)) is None else df.columns for name in ("kbs", "pages", "chunks")}
