from millrace.plans import catalog_queries, registry

SMALL = "/root/testdata/sf0.001"


def test_a_task_joins_a_bounded_number_of_line_items(spark, monkeypatch):
    want = sorted(map(tuple, registry.queries()["constraint_violations"](spark, SMALL).collect()))
    monkeypatch.setattr(catalog_queries, "ROWS_A_TASK", 500)
    chunks = catalog_queries.tables(spark, SMALL)[2]
    sizes = chunks.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) > 5000 and len(sizes) >= 12 and max(sizes) < 1000
    assert sorted(map(tuple, registry.queries()["constraint_violations"](spark, SMALL).collect())) == want


def test_scoring_is_bounded_and_takes_any_number_of_queries(spark, monkeypatch):
    import numpy as np

    from millrace.operators import vectors

    x = np.random.default_rng(3).normal(size=(900, 8)).astype(np.float32)
    x[100:300] = x[0]  # equal scores
    chunks = spark.createDataFrame([(i, 0, 1, v.tolist()) for i, v in enumerate(x)], "chunk_id long, kb_id int, token_count int, embedding array<float>").coalesce(1).cache()
    asked = chunks.where("chunk_id % 20 = 0").selectExpr("chunk_id query_id", "embedding query")
    shown = lambda df: sorted((r.query_id, r["rank"], round(r.score, 6)) for r in vectors.top_k(df, 5).collect())
    every = vectors.scored(asked, chunks, -1.0).cache()
    want = shown(every)
    assert every.count() == 45 * 900 and len(want) == 45 * 5
    for name, most in (("MOST_QUERIES", 20), ("QUERIES_AT_ONCE", 7), ("PAIRS", 70)):
        monkeypatch.setattr(vectors, name, most)
    found = vectors.scored(asked, chunks, -1.0, most=5).cache()
    assert shown(found) == want
    ties = 11 * 201  # rows in one place, asked for by those of them that are queries
    assert found.count() < ties + 45 * 900 / 4  # a step alone holds 10 rows, of which 5 would pass
