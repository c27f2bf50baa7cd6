"""Urls, extraction, crawling, grounding, answers, catalog and the engine as a whole."""

import pytest
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions import urls as u
from millrace.operators import answer, catalog, chunk, clean, crawl, ground, vectors
from millrace.plans import registry
from millrace.plans.engine import Engine
from millrace.sources.html import extract, extracted

SITE = "https://site.org/wiki/start"
TEXT = "The old mill was built beside the river in the year of the great flood. It ground grain for the villages around it until the railway came. "


def test_normalized_urls(spark):
    cases = {"HTTP://A.org/x/?utm_source=1&b=2&a=1#top": "http://a.org/x/?b=2&a=1", "https://a.org": "https://a.org/", "https://a.org/x/": "https://a.org/x", "ftp://a.org": None, "https://a.org/?ref=1": "https://a.org/"}
    cases["HTTP://A.org/x/?utm_source=1&b=2&a=1#top"] = "http://a.org/x/?a=1&b=2"
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.n for r in df.select("x", u.normalized(F.col("x")).alias("n")).collect()} == cases


@pytest.mark.parametrize(
    ("href", "target"),
    [
        ("/wiki/River", "https://site.org/wiki/River"), ("River?a=1", "https://site.org/wiki/River?a=1"), ("../about", "https://site.org/about"), ("//site.org/wiki/B", "https://site.org/wiki/B"), ("#top", None), ("mailto:a@b.c", None), ("", None),
        ("https://other.org/x", None), ("/file.PDF", None), ("/wiki/Help:Contents", None), ("/login", None), ("/wiki/login-history", "https://site.org/wiki/login-history"), ("/", None), ("/index.html", None), ("/wiki/Mill_%28disambiguation%29", None),
        ("/wiki/start", "https://site.org/wiki/start"), ("?page=2", "https://site.org/wiki/start?page=2"), ("/100%", "https://site.org/100%"),
    ],
)
def test_eligible_links(spark, href, target):
    row = spark.createDataFrame([(href, SITE)], "h string, c string").select(u.eligible(F.col("h"), F.col("c"), F.lit("/wiki/start")).alias("t")).first()
    assert row.t == target


def test_disambiguation(spark):
    rows = [("Mill (disambiguation)", "", True), ("Mill", "Mill may refer to: a, b", True), ("Mill", "Mill may refer to " + "x" * 5000, False), ("Mill", TEXT, False), (None, None, False)]
    df = spark.createDataFrame(rows, "title string, text string, want boolean")
    assert all(r.got == r.want for r in df.select("want", u.is_disambiguation(F.col("title"), F.col("text")).alias("got")).collect())


def test_extraction():
    html = '<html><head><title> A  T </title><script>var x="<p>no</p>"</script></head><body><nav><a href="/n">n</a></nav><div class="ads">ad</div><article><h2>Head</h2><p>One<br>two<p>Three <b>four</b><p>Three four<div><span>in</span><span>ner</span></div><ul><li>ab<li>item</ul><p hidden>gone</p></article></body>'
    x = extract(html, "u")
    assert x["title"] == "A T" and x["links"] == ["/n"] and x["headings"] == ["Head"]
    assert x["paragraphs"] == ["One two", "Three four", "ner", "item"] and x["text"] == "## Head\n\nOne two\nThree four\nner\nitem"
    assert extract("", "u")["title"] == "u" and extract(None, "u")["text"] == "" and extract("<div>" * 5000 + "deep", "u")["text"] == "deep"


def test_crawl(spark):
    page = lambda path, links: (path, f"https://site.org{path}", f"<title>{path}</title><p>{TEXT}{path}</p>" + "".join(f'<a href="{x}">l</a>' for x in links))
    rows = [page("/wiki/start", ["/other", "/wiki/b", "/login", "/wiki/gone"]), page("/wiki/b", ["/wiki/c", "/wiki/start"]), page("/other", []), page("/wiki/c", [])]
    pages = extracted(spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "page_id long, url string, html string"))
    assert [r.url for r in crawl.crawl(pages, SITE, 3)] == [SITE, "https://site.org/wiki/b", "https://site.org/other"]
    with pytest.raises(ValueError):
        crawl.crawl(pages, "https://site.org/none")


def test_grounding(spark):
    q = [(1, "Tell me about the mill", TEXT.lower()), (2, "What about quantum mills", TEXT.lower()), (3, "Explain this", ""), (4, "railways and villages", TEXT.lower()), (5, "castle", "other text")]
    df = spark.createDataFrame(q, "question_id int, question string, haystack string")
    corpus = spark.createDataFrame([(TEXT,), ("A castle stood here.",), (None,)], "text string")
    assert {r.question_id: r.grounded for r in ground.gate(df, corpus).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    turns = spark.createDataFrame([(1, 0, "user", "Where is the mill?"), (1, 1, "assistant", "By the castle."), (1, 2, "user", "tell me more")], "conv_id int, turn int, role string, text string")
    assert ground.resolved(turns).where("turn = 2").first().query == "Where is the mill? tell me more"
    asked = ["Write an essay on mills", "explain in detail", "What is a mill?", "go deeper please"]
    assert [r.x for r in spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, t string").orderBy("i").select(ground.wants_long(F.col("t")).alias("x")).collect()] == [True, True, False, True]


def test_answers(spark):
    rows = [("## Title\n1. first point. Second is cut", "Title 1. first point. Second is cut"), ("2. The mill stood beside the river for a century. And then the", "The mill stood beside the river for a century."), ("Done.", "Done."), (answer.REFUSAL, answer.REFUSAL)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, w string").orderBy("i").select("w", answer.tidied("a").alias("t"), answer.is_refusal(F.col("a")).alias("r"), answer.is_stub(F.col("a")).alias("s"), answer.stopped(F.col("a")).alias("cut")).collect()
    assert [r.t for r in got] == [r.w for r in got] and [r.r for r in got] == [False, False, False, True] and got[2].s


def test_budget_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, 1, 2000, 0.9), (1, 2, 10, 0.8), (2, 1, 500, 0.9), (2, 2, 700, 0.8), (2, 3, 100, 0.7), (2, 4, 100, 0.6), (2, 5, 100, 0.5), (2, 6, 1, 0.4)], "query_id int, rank int, token_count int, score double")
    got = vectors.select_within_budget(hits, 4, 1100).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(1, 1), (2, 1), (2, 3), (2, 4), (2, 5)]


def test_scores_and_index_equal_plain_cosine(spark):
    import numpy as np

    from millrace.operators import index

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[1000:1400] = x[0]  # a third of all rows in one place
    rows = [(i, i % 3, 1, v.tolist()) for i, v in enumerate(x)] + [(9000, 0, 1, None), (9001, 0, 1, [0.0] * 12), (9002, 0, 1, [1.0] * 5), (9003, 0, 1, [float("nan")] * 12)]
    chunks = spark.createDataFrame(rows, "chunk_id long, kb_id int, token_count int, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i * 37].tolist()) for i in range(30)] + [(99, None)], "query_id int, query array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {i: sorted((-round(float(s), 5), k) for k, s in enumerate(unit @ unit[i * 37]))[:8] for i in range(30)}
    got = {}
    for r in vectors.top_k(vectors.scored(asked, chunks, -1.0, most=8), 8).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 5), r.chunk_id))
    assert {k: [s for s, _ in sorted(v)] for k, v in got.items()} == {k: [s for s, _ in v] for k, v in want.items()}
    centres = index.fit(chunks, 32)
    table = index.indexed(chunks, centres)
    assert table.where("cell < 0").count() == 4 and table.count() == len(rows)
    found = {(r.query_id, r.chunk_id) for r in index.search(asked, table, centres, 8).collect()}
    exact = {(k, c) for k, v in want.items() for _, c in v}
    assert len(found & exact) >= 0.9 * len(exact)


def test_catalog(spark):
    kbs = spark.createDataFrame([("1", "a", "A", "indexing", None, 0, 0), ("2", "b", "B", "indexing", None, 0, 0), ("3", "c", "C", "ready", None, 1, 1)], catalog.SCHEMA)
    pages, chunks = spark.createDataFrame([(1, "1", "u")], "page_id int, kb_id string, url string"), spark.createDataFrame([(1, "1", 0), (1, "1", 1)], "page_id int, kb_id string, chunk_index int")
    assert {r.id: (r.status, r.chunk_count) for r in catalog.recovered(kbs, pages, chunks).collect()} == {"1": ("ready", 2), "2": ("failed", 0), "3": ("ready", 1)}
    assert catalog.next_status("indexing", "fail", 3) == "ready" and catalog.next_status("indexing", "fail") == "failed"
    with pytest.raises(ValueError):
        catalog.next_status("ready", "finish")
    assert EngineConfig().page_limit(99) == 30 and EngineConfig().page_limit(None) == 12


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), EngineConfig(chunk_tokens=64, overlap_tokens=8, min_score=0.1, max_sites=1))
    asked = spark.createDataFrame([(1, "When was the old mill built beside the river?"), (2, "Who invented the telescope?")], "question_id int, question string")
    assert all(r.refusal for r in engine.ask(asked).collect())
    pages = spark.createDataFrame([(1, "https://m.org/a", "Mill", TEXT * 3), (2, "https://m.org/b", "Bees", "Bees keep their honey in wax cells that they build in the dark of the hive.")], "page_id long, url string, title string, text string")
    assert engine.index("https://m.org", pages) == "ready"
    got = {r.question_id: r for r in engine.ask(asked).collect()}
    assert "mill was built" in got[1].answer and got[1].sources[0].url == "https://m.org/a" and got[2].refusal and not got[2].sources
    assert got[1].sources[0].title == "Mill" and got[1].sources[0].site_title == "m.org" and engine.index("https://m.org", pages.limit(0)) == "ready"
    with pytest.raises(ValueError):
        engine.index("https://n.org", pages)
    first = engine.read("chunks").orderBy("chunk_id").select("chunk_id", "created_at").collect()
    changed = pages.withColumn("text", F.when(F.col("page_id") == 2, F.concat("text", F.lit(" The queen alone lays eggs there, and she does so all summer."))).otherwise(F.col("text")))
    assert engine.index("https://m.org", changed, use_cache=False) == "ready"
    then = {r.chunk_id: r.created_at for r in engine.read("chunks").collect()}
    assert all((then[r.chunk_id] == r.created_at) == r.chunk_id.startswith("1:") for r in first)
    before = engine.sites().first()
    assert engine.index("https://m.org", pages.limit(0), use_cache=False) == "ready" and engine.read("chunks").count() == len(then)
    assert engine.reindex(lambda site: pages) == {"https://m.org": "ready"} and engine.sites().first().updated_at > before.updated_at
    assert engine.query_one("select count(*) n from {chunks} where kb_id = :kb", {"kb": before.id}).n == engine.read("chunks").count() and "created_at" in engine.check()["kbs"]
    engine._save(engine._catalog().withColumn("status", F.lit("indexing")))
    with pytest.raises(ValueError):
        engine.index("https://m.org", pages)
    engine.open()
    assert engine.sites().first().status == "ready"
    assert engine.stats().first().chunks == engine.read("chunks").count()
    engine.delete("https://m.org")
    assert engine.stats().first().pages == 0


def test_engine_survives_a_broken_write(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), EngineConfig(chunk_tokens=64, overlap_tokens=8))
    assert engine.stats().first().asDict() == {"ready_sites": 0, "total_sites": 0, "pages": 0, "chunks": 0} and engine.check() == {"kbs": None, "pages": None, "chunks": None}
    pages = spark.createDataFrame([(1, "https://m.org/a", "Mill", TEXT * 3)], "page_id long, url string, title string, text string")
    broken = pages.withColumn("text", F.expr("cast(raise_error('torn page') as string)"))
    with pytest.raises(Exception, match="torn page"):
        engine.index("https://m.org", broken)
    assert engine.sites().first().status == "failed" and "torn page" in engine.sites().first().error
    assert engine.index("https://m.org", pages) == "ready"
    with pytest.raises(Exception, match="torn page"):
        engine.index("https://m.org", broken, use_cache=False)
    assert engine.sites().first().status == "ready" and engine.stats().first().chunks > 0
    number, manifest = engine._manifest()
    with pytest.raises(RuntimeError):
        engine._publish(number, manifest)


def test_stored_pages_and_command_line(spark, tmp_path, capsys):
    from millrace.__main__ import main

    html = lambda name, links: f"<title>{name}</title><p>{TEXT}{name} stands there still.</p>" + "".join(f'<a href="{x}">l</a>' for x in links)
    raw = [(1, "https://m.org/a", html("Mill", ["/b", "/c"])), (2, "https://m.org/b", html("Barn", [])), (3, "https://m.org/c", html("Ford", [])), (4, "https://n.org/", html("Other", []))]
    spark.createDataFrame(raw, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    store = str(tmp_path / "store")
    main([store, "index", "m.org/a", str(tmp_path / "pages.parquet"), "--max-pages", "2"])
    main([store, "reindex", str(tmp_path / "pages.parquet")])
    main([store, "ask", "When", "was", "the", "old", "mill", "built", "beside", "the", "river?"])
    said = capsys.readouterr().out
    assert said.startswith("ready") and "https://m.org/a ready" in said and "mill was built" in said
    main([store, "stats"])
    main([store, "delete", "https://m.org/a"])
    main([store, "sites"])
    assert Engine(spark, store).stats().first().pages == 0


def test_plans_stay_native(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("clean_documents", "chunk_pack", "lexical_gate"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
    documents = spark.read.parquet(f"{folder}/documents.parquet")  # the queries may deal a small file over the cores first, the operators do not shuffle
    for df in (clean.cleaned(documents), chunk.build_chunks(clean.cleaned(documents))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, folder)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    shown = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    assert sorted([shown(v) for v in r] for r in map(tuple, df.select(*names).collect())) == sorted([shown(v) for v in r] for r in got.fetchall())
