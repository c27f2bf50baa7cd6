import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import exploded
from millrace.operators import chunk, clean, passages
from millrace.plans import registry

PIECES = [
    "## References", "## Films", "## History [edit]", "##", "## ", "## Odd mark", "## ## Twice", "References", "Menu", "Share", "© 2020 A. Smith", "We use COOKIES to enhance your experience", "cookie \r consent",
    "cooKie analytics", "Cookies here enhance it", "Join our newsletter", "1.2 Origins", "A3. Part of the whole.", "1 One 1.1 Two 1.2 Three 2.1 Four", "12.5 and 13.5, A1.2 or 9.9 B2.2", "See ISBN 0-123", "doi of it", "pp. 12-13, 14 – 15, 16-",
    "{{cite web}}", "Retrieved 12 May 2001", "(London: Press, 1999)", "ab", "x", "\xa0\xa0Two  \t words\xa0", " ﻿", "\x1c\x1d odd\x85 white​space\x1f", "İstanbul ΑΣ ΑΣ.", "istanbul", "ſtop K elvin", "漢字かな交じり文" * 9, "😀😀 wall 😀!" * 7, "wall " * 90, "\"Quite so.\"", "so.')",
    "The mill was built by the river so that grain could be ground.", "The mill was built by the river so that grain could be ground.", "THE MILL was built by the river so that grain could be ground.", "It stands. It stood! Did it? Nobody knows (or says) it now.", "Green Apples Press", "Smith, John", "North Gate Books and the Long Road",
    "a sentence without end that goes on for more than eight words", "No. 5", "12345678901234567890", "!!!", "..." * 50, "",
]


def _texts():
    r = random.Random(11)
    out = ["\n".join(r.choice(PIECES) for _ in range(r.choice((0, 1, 2, 5, 12, 40, 90)))) for _ in range(500)]
    out += [r.choice(("\n", "\n\n", " ", "\n\n\n\n")).join(r.choice(PIECES) for _ in range(30)) for _ in range(200)]
    signs = "aB9 .!?\n\n\t\r\x0b\x0c\x1c\x85\xa0   　﻿​\"')]#-–漢😀é"
    return [*out, *("".join(r.choice(signs) for _ in range(r.choice((3, 30, 400)))) for _ in range(300)), "", None, "   "]


def test_one_pass_equals_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "i int, text string").cache()
    want = {r.i: r.cleaned for r in clean.cleaned(df).select("i", "cleaned").collect()}
    assert {i: t and passages.cleaned(t) for i, t in enumerate(_texts()) if t is not None} == {i: t for i, t in want.items() if t is not None}
    for size, overlap in ((128, 24), (16, 4)):
        by_rule = exploded(chunk.with_chunks(clean.cleaned(df), "cleaned", size, overlap), ["i"], F.expr(chunk.refined()), "chunk_index", "c").select("i", "chunk_index", "c.text", "c.tokens")
        got = passages.built(df, ["i"], chunk_tokens=size, overlap_tokens=overlap)
        assert got.columns == ["i", "chunk_index", "text", "token_count"] and got.count() > 500
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_rule.collect()))
    with pytest.raises(ValueError):
        passages.built(df, ["i"], chunk_tokens=16, overlap_tokens=16)


def test_a_cap_makes_chunks_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = [(p % 3, p, i) for p in range(60) for i in range(3)]
    chunks = spark.createDataFrame(rows, "kb int, page int, chunk_index int").mapInArrow(made, "kb int, page int, chunk_index int")
    assert len(chunk.capped(chunks, 7, "page", "kb").collect()) == 21
    assert runs.value == len(rows)
    plan = registry.queries()["chunk_cap_reindex"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_builds_cost_well_under_the_expressions(spark):
    import time

    text = "\n".join(f"## Part {i}" if i % 50 == 0 else f"Line {i} tells of the {i % 977} barges that came down the river." for i in range(3000))
    df = spark.createDataFrame([(i, text) for i in range(8)], "doc_id int, text string").repartition(4).cache()
    by_rule = exploded(chunk.with_chunks(clean.cleaned(df), "cleaned", 128, 24), ["doc_id"], F.expr(chunk.refined()), "chunk_index", "c")

    def seconds(made):
        took = []
        for _ in range(3):
            began = time.time()
            made.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert seconds(passages.built(df, ["doc_id"], chunk_tokens=128, overlap_tokens=24)) < seconds(by_rule) / 2


def test_engine_indexes_in_the_pass_and_lists_the_same_terms(spark):
    from millrace.config import EngineConfig
    from millrace.operators import ground
    from millrace.plans import engine

    df = spark.createDataFrame(list(enumerate(_texts())), "i int, text string").withColumn("said", F.expr(ground.lettered_sql("text"))).withColumn("terms", ground.terms(F.col("text")))
    assert all(ground.lettered_terms(r.said) == (None if r.terms is None else [t for t in r.terms]) for r in df.collect())
    pages = spark.createDataFrame([(1, "a", "u", "t", "x")], "page_id int, kb_id string, url string, title string, text string")
    plan = engine.indexed(pages, EngineConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
