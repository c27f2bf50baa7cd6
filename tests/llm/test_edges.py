"""Odd rows for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, langid, minhash, packing, pii, quality, toxicity, urls, warc

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while the sun sets slowly behind the old stone mill and birds sing. "
LONG = " ".join(f"word{i}" for i in range(30_000))
RUN = "x" * 200_000
DIGITS = "7" * 20_000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE), (None, None), (6, LONG), (7, RUN), (8, DIGITS), (9, "éàü ß 漢字 😀\x00"), (10, "+" + "1 " * 5000), (11, "a@" * 3000),
    (12, "1." * 5000), (13, " " * 50_000 + "\u00a0"),
]
CLASHING = "doc_id long, text string, id long, key string, row string, n int, bucket string, node long, u long, v long, lane long, part int, ids string, pii string, lines string, words string, size int, component_id int"


@pytest.fixture(scope="module")
def odd(spark):
    rest = [1, "k", "r", 2, "b", 3, 4, 5, 6, 7, "i", "p", "l", "w", 8, 9]
    return spark.createDataFrame([(*r, *rest) for r in ROWS], CLASHING)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_quality(odd, empty):
    rows = quality.judge_documents(odd, carry=("id", "text")).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[1].cleaned is None
    assert got[6].n_words == 30_000 and got[6].kept
    assert got[7].word_chars == 200_000
    assert quality.judge_documents(empty).count() == 0


def test_near_duplicates(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id == 5:
            assert r.component_id == 4 and not r.kept
        if r.doc_id == 4:
            assert r.component_id == 4 and r.kept
        if r.doc_id in (1, 2, 3):
            assert r.n_shingles == 0 and r.component_id == r.doc_id
    nulls = sorted((r.component_id or 0, r.kept) for r in rows if r.doc_id is None)
    assert nulls == [(0, True), (4, False)]
    assert minhash.near_duplicates(empty).count() == 0


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_personal_data(odd, empty):
    found = pii.find_personal_data(odd)
    assert set(found.columns) == set(odd.columns)
    rows = found.select("doc_id", "pii", pii.redacted().alias("r"), "text").collect()
    assert len(rows) == len(ROWS)
    assert all(r.r == r.text for r in rows if not r.pii.spans)
    assert pii.digest(pii.find_personal_data(empty)).count() == 0


def test_language(odd, empty):
    labelled = odd.withColumn("lang", F.lit("en")).where("doc_id = 4")
    rows = langid.identify(odd, labelled).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r.lang_pred for r in rows}
    assert got[1] == got[2] == got[8] == "und" and got[5] == "en"
    assert {r.lang_pred for r in langid.identify(odd, labelled.where("false")).collect()} == {"und"}
    assert langid.identify(empty, labelled).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "nonsense": ("", "", None, "allow"), "http://a.NET/x?y": ("a.net", "/x", "net/", "block"), "http://example.net/en/1#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"), "x://y.example.com/de/://z": ("y.example.com", "/de/://z", "example.com/de/", "block"),
        "http://" + "a." * 2000 + "org/fr/" + "b/" * 2000: ("a." * 2000 + "org", "/fr/" + "b/" * 2000, "org/fr/", "allow"), "http://org/frx/": ("org", "/frx/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(cases)] + [(0, None, "x", 1)], "page_id int, url string, host string, row int")
    rows = urls.judge_urls(pages, rules).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.where("false"), default="block").collect()} == {"block"}


@pytest.mark.parametrize("most", [0, 100])
def test_urls_by_shuffle_and_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules = spark.createDataFrame([("block", "b.com", "/x/pre"), ("allow", "b.com", "/x/prefix"), ("block", "B.com", ""), (None, "c.com", "/"), ("allow", None, None)], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://b.com/x/prefixed"), (2, "http://b.com/x/press"), (3, "http://w.b.com"), (4, "http://c.com/")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: ("b.com/x/prefix", "allow"), 2: ("b.com/x/pre", "block"), 3: ("b.com", "block"), 4: (None, "allow")}


def test_contamination(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, "Jumps, over"), (3, None), (5, " "), (6, "too short"), (4, " ".join(f"word{i}" for i in range(1020, 1060)))], "item_id long, text string")
    for most in (0, 10_000):
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
        got = sorted((r.doc_id or 0, r.item_id, r.similarity, r.start) for r in decontaminate.contaminated(odd, items).collect())
        assert got == [(0, 1, 1.0, 0), (0, 2, 1.0, 4), (4, 1, 1.0, 0), (4, 2, 1.0, 4), (5, 1, 1.0, 0), (5, 2, 1.0, 4), (6, 4, 1.0, 1020)]
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "a\\e<|end|>\n"), (2, 0, "assistant", "<<s>[[INST]\\\\"), (2, 1, "user", "x"), (None, 0, "user", ""), (3, 0, "user", "y" * 100_000)]
    conv = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, example int")
    got = {r.conv_id: r for r in chat.digest(chat.examples(conv)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("\na\\e<|end|>\n\nuser\nhi\nassistant\n\nassistant\n\n")
    assert got[2].loss_sha256 == sha("<<s>[[INST]\\\\") and got[2].n_turns == 2
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    made = chat.examples(conv).collect()
    for r in made:
        if r.loss_start is not None:
            assert r.formatted[r.loss_end :] == "<|end|>\n"
    assert chat.digest(chat.examples(conv.where("false"))).count() == 0


def test_revisits(spark):
    t = "timestamp'2024-01-01 00:00:00'"
    rows = [
        (1, "http://A.com:80/x/?b=2&utm_source=q&a=1#f", 0, "response", 200, {"etag": '"1"', "content-type": "text/html", "age": "1"}, "d1"), (2, "http://a.com/x?a=1&b=2", 10, "revisit", 304, {"etag": 'W/"1"', "content-type": "no", "age": "9"}, None),
        (3, "http://a.com/x?a=1&b=2", 7200, "response", 200, {"last-modified": "L"}, "d3"), (4, "http://a.com/x?a=1&b=2", 9000, "revisit", 304, {"last-modified": "L"}, None), (5, "http://a.com/x?a=1&b=2", 90_000, "revisit", 304, {"etag": '"1"'}, None),
        (6, "http://a.com/x?a=1&b=2", 90_000, "revisit", 304, None, None), (7, "http://b.com/", 5, "revisit", 304, {}, None), (8, None, 5, "revisit", 304, {}, None), (9, "http://a.com/x?a=1&b=2", None, "revisit", 304, {}, None),
        (10, "http://c.com", 5, "response", 404, {}, "d"), (11, "http://c.com/", 6, "revisit", 304, {}, None), (12, "http://d.com", 6, "response", 200, {}, "d12"), (13, "http://d.com", 6, "response", 200, None, "d13"), (14, "http://d.com", 6, "revisit", 304, {}, None),
    ]
    caps = spark.createDataFrame(rows, "record_id long, uri string, at long, kind string, status int, headers map<string,string>, payload_digest string").withColumn("time", F.expr(f"{t} + make_dt_interval(0, 0, 0, at)")).withColumn("url", F.lit("clash"))
    got = {r.record_id: r for r in warc.resolve_revisits(caps).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        2: ("resolved", 1), 4: ("resolved", 3), 5: ("changed", None), 6: ("unvalidated", 3), 7: ("missing", None), 8: ("missing", None), 9: ("missing", None), 11: ("missing", None), 14: ("unvalidated", 13),
    }
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "age": "9"} and got[2].payload_digest == "d1"
    assert warc.resolve_revisits(caps.where("false")).count() == 0


def test_urls_of_captures(spark):
    """Empty and very long urls are keys like any other."""
    long = "http://a.com/" + "x/" * 50_000
    rows = [(1, "", 0, "response", 200), (2, "", 5, "revisit", 304), (3, long, 0, "response", 200), (4, long + "#z", 5, "revisit", 304), (4, long + "#z", 5, "revisit", 304)]
    caps = spark.createDataFrame(rows, "record_id long, uri string, at long, kind string, status int").select("*", F.timestamp_seconds("at").alias("time"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("d").alias("payload_digest"))
    assert sorted((r.record_id, r.response_id) for r in warc.resolve_revisits(caps).collect()) == [(2, 1), (4, 3), (4, 3)]


@pytest.mark.parametrize("zipped", ["records", "whole", "no"])
def test_warc_files(spark, tmp_path, zipped):
    import gzip

    def record(kind, number, date, http, uri="http://a.com/x"):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    body = b"WARC/1.1 is named in this page\r\n\r\nand so is a blank line" * 3000
    records = [
        record("warcinfo", 0, "2024-01-01T00:00:00Z", b"software: none"), record("response", 1, "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\nVia: a\r\nVia: b\r\n\r\n" + body),
        record("revisit", 2, "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nAge: 5\r\n\r\n"), record("revisit", 3, "no date", b"HTTP/1.1 304\r\n\r\n"), record("response", 4, "2024-01-03T00:00:00Z", b"x" * 50)[:-30],
    ]
    made = {"records": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records)), "no": b"".join(records)}[zipped]
    (tmp_path / "a.warc").write_bytes(made)
    (tmp_path / "empty.warc").write_bytes(b"")
    caps = warc.read_warc(spark, str(tmp_path))
    got = {r.record_id: r for r in caps.collect()}
    assert sorted(got) == ["<urn:1>", "<urn:2>", "<urn:3>"] and got["<urn:1>"].headers == {"etag": '"1"', "content-type": "text/html", "via": "a, b"} and got["<urn:3>"].time is None and got["<urn:3>"].status == 304
    out = {r.record_id: r for r in warc.resolve_revisits(caps).collect()}
    assert (out["<urn:2>"].outcome, out["<urn:2>"].response_id, out["<urn:3>"].outcome) == ("resolved", "<urn:1>", "missing") and out["<urn:2>"].payload_digest.startswith("sha1:")


def test_a_hot_conversation(spark):
    """One conversation with a third of all turns keeps them all, in order."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(600)] + [(2 + i // 2, i % 2, "assistant" if i % 2 else "user", "x") for i in range(1200)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.digest(chat.examples(conv)).collect()}
    said = "".join(f"turn {i}" for i in range(1, 600, 2))
    assert len(got) == 601 and got[1].n_turns == 600 and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_pipeline_rows_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None, PROSE), (None, PROSE), (None, "Another text. " * 30), (7, PROSE), (8, "A text of its own, told at length. " * 9), (8, "A text of its own, told at length. " * 9), (8, "Quite another thing under the same id. " * 9), (9, None), (9, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    kept = corpus_pipeline.near_dedup(spark, docs.select(*corpus_pipeline.COLUMNS), "")
    texts = sorted((r.text or "")[:12] for r in kept.collect())
    assert texts == sorted(["", "", "", "", "A text of it", "Another text", "Quite anothe", "The quick br"])
    assert corpus_pipeline.near_dedup(spark, docs.where("false").select(*corpus_pipeline.COLUMNS), "").count() == 0
