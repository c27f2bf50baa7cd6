"""Embedding with failures, and token counts by a vocabulary file."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import bpe, remote
from tests.test_text import _restated


def _vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def test_failed_texts_become_error_rows(spark):
    def flaky(texts, calls=[0]):  # noqa: B006
        calls[0] += 1
        if calls[0] % 3 == 1:
            raise ConnectionError("busy")
        if any("bad" in t for t in texts):
            raise ValueError("no vector for this")
        return [[1.0, 2.0] if "short" not in t else [1.0] for t in texts]

    rows = [(1, "good one"), (2, "bad one"), (3, None), (4, ""), (5, "short one"), (6, "good again")]
    df = spark.createDataFrame(rows, "i int, content string").coalesce(1)
    got = {r.i: (r.embedding, r.embedding_error) for r in remote.embedded_by(df, flaky, 2, wait=0.01).collect()}
    assert got[1] == ([1.0, 2.0], None) and got[6] == ([1.0, 2.0], None) and got[3] == got[4] == (None, None)
    assert got[2] == (None, "no vector for this") and "expected" in got[5][1]


def test_counts_and_truncation_by_a_vocabulary(spark):
    from tokenizers import Tokenizer

    path = _vocabulary()
    exact = Tokenizer.from_file(path)
    texts = ["", None, "The weir holds back water.", "漢字 and é", "word " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", bpe.counted("t", path).alias("n"), bpe.truncated("t", path, 5).alias("head")).collect():
        n = len(exact.encode(r.t or "", add_special_tokens=False).ids)
        assert r.n == n and ((r.head or "") == (r.t or "") if n <= 5 else r.t.startswith(r.head) and len(exact.encode(r.head, add_special_tokens=False).ids) <= 5)


def test_chunks_by_a_vocabulary(spark):
    r = random.Random(3)
    sizes = [[r.randint(1, 64) for _ in range(r.randint(0, 30))] for _ in range(60)]
    for own in sizes:
        got = [[int(t) for t in c.split("\n")] for c, _ in bpe.packed([(str(n), n) for n in own], 128, 24)]
        assert got == _restated(own, 128, 24)
    texts = [" ".join(f"Sentence number {i} is short." for i in range(300)), "wall " * 3000, "漢字" * 900, "", None, "   ", "Tiny."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("chunks", F.lit(1))
    got = {x.i: x.chunks for x in bpe.with_chunks(df, _vocabulary(), "text", 128, 16).collect()}
    assert all(c.tokens <= 128 for k in (0, 1, 2) for c in got[k]) and all(len(got[k]) > 3 for k in (0, 1, 2))
    assert got[3] == got[4] == got[5] == [] and [c.text for c in got[6]] == ["Tiny."]
    with pytest.raises(ValueError):
        bpe.with_chunks(df, _vocabulary(), "text", 64, 64)
