"""Queries over small rows of their own, with expected rows written by hand.

The tables of a folder hold no closing apparatus, contents, citations, site machinery, follow-ups or refusals, so the rules for these would be compared on rows that they leave
alone. Here each rule meets lines that it takes and near misses that it leaves. The SQL states the expected rows; no pattern is shared with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import answer as a
from ..operators import clean, crawl
from ..operators import ground as g

_SECTIONS = (
    "The harbour was dug by hand over nine winters.\n## References\nHarbour Board, yearly report.\nLoose sheet of tolls.\n## Books\nTide Tables of the Coast\n## Trade\nSalt and timber left the quay each spring.\n"
    "## External links [edit]\nPort office page\n## Weather\nFog is common until noon."
)
_KEPT_HEADING = "## Sources of the river\nThree springs feed it.\n## Books\nBooks were bound here for the abbey."
_CONTENTS = "1.2 Building the quay\n3.1 Who paid for it\n4 barges sank that year.\nB2.1 Lists of tolls\n1.1 Quay 1.2 Lock 1.3 Weir\nDepth rose from 2.5 to 3.5 metres and then to 4.5 metres after the flood of that long year.\n2 Storms and repairs"
_CITED = (
    "Tolls of the old port, ISBN 000-1\nSee {{cite web|x}} for more\nRetrieved 3 March 2011 from the archive\nArchived from the original on a spring day\n(Lisbon: Quay Press, 1987)\npp. 3-9, 12-18, 40-44\n"
    "The lock opened in 1987 and closed in 1990.\nRooms 3-9 are on the left side."
)
_CLEAN = [("sections", _SECTIONS), ("heading", _KEPT_HEADING), ("contents", _CONTENTS), ("cited", _CITED)]
_VERDICTS = [
    ("sections", 0, "kept"), *[("sections", i, "tail") for i in range(1, 6)], ("sections", 6, "kept"), ("sections", 7, "kept"), ("sections", 8, "tail"), ("sections", 9, "tail"), ("sections", 10, "kept"), ("sections", 11, "kept"),
    *[("heading", i, "kept") for i in range(4)], ("contents", 0, "contents"), ("contents", 1, "contents"), ("contents", 2, "kept"), ("contents", 3, "contents"), ("contents", 4, "contents"), ("contents", 5, "kept"), ("contents", 6, "contents"),
    *[("cited", i, "citation") for i in range(6)], ("cited", 6, "kept"), ("cited", 7, "kept"),
]

_AT = "http://port.example/town/quay"
#: href, and its target from _AT, whose path is the start of the crawl; None if a crawl does not follow it.
_LINKS = [
    ("lock", "http://port.example/town/lock"), ("/town/../mill/./wheel", "http://port.example/mill/wheel"), ("http://port.example:80/town/x", "http://port.example/town/x"), ("http://port.example:8080/town/x", None),
    ("https://port.example/town/x", None), ("http://a:b@port.example/town/y", "http://port.example/town/y"), ("?b&a=1&utm_source=z", "http://port.example/town/quay?a=1&b="), ("/find?q=old%20mill&q=a+b", "http://port.example/find?q=old+mill&q=a+b"),
    ("//port.example/town/z/", "http://port.example/town/z"), ("/town/quay#top", "http://port.example/town/quay"), ("#top", None), ("", None), ("   ", None), ("mailto:harbour@port.example", None), ("tel:123", None), ("javascript:void(0)", None), ("ftp://port.example/a", None),
    ("http://other.example/town", None), ("/map.PDF", None), ("/a.jpeg?x=1", None), ("/town/pdf-guide", "http://port.example/town/pdf-guide"), ("/wiki/Help:Editing", None), ("/wiki/Talk%3AQuay", None), ("/wiki/Category:Ports", None), ("/wiki/Categories", "http://port.example/wiki/Categories"),
    ("/login", None), ("/user/account/", None), ("/privacy", None), ("/loginhistory", "http://port.example/loginhistory"), ("/town/search", None), ("/town/search-parties", "http://port.example/town/search-parties"),
    ("/", None), ("/index.html", None), ("/wiki/Main_Page", None), ("/home", None), ("/homes", "http://port.example/homes"), ("/wiki/Quay_(disambiguation)", None), ("/wiki/Quay_%28disambiguation%29", None), ("/wiki/Quay_%28town%29", "http://port.example/wiki/Quay_%28town%29"),
]
#: A crawl that starts on site machinery may come back to it.
_STARTED = [("/login", "http://port.example/login"), ("/logout", None)]

_PAGES = [
    ("Weir (disambiguation)", "A list.", True), ("Weir", "Weir may refer to: a dam, a net, a town.", True), ("Weir", "Weir may also refer to a kind of net.", True), ("Weir", "Nets and dams. This disambiguation page lists articles associated with the title Weir.", True),
    ("Weir", "Topics referred to by the same term", True), ("Weir", "Weir may refer to two things. " + "It holds back water. " * 300, False), ("Weir", "A weir holds back water. " * 30 + "The word may refer to nets.", False), ("Weir", "Anglers refer to it as the wall.", False), (None, None, False),
]
_ASKED = [
    ("Write an essay about the weir", True, 8), ("Explain in detail how locks work", True, 8), ("Can you elaborate on that?", True, 8), ("Give me a longer answer", True, 8), ("Go deeper into the tolls", True, 8), ("I want several paragraphs on salt", True, 8),
    ("Who built the weir?", False, 4), ("What is a detail?", False, 4), ("Is the lane long?", False, 4),
]
_TALK = [
    (1, 1, "user", "Who dug the harbour?", "Who dug the harbour?"), (1, 2, "assistant", "Convicts dug it.", "Convicts dug it."), (1, 3, "user", "tell me more about that", "Who dug the harbour? tell me more about that"),
    (1, 4, "user", "When did salt trading stop?", "When did salt trading stop?"), (1, 5, "user", "why?", "When did salt trading stop? why?"), (2, 1, "assistant", "Ask about ports.", "Ask about ports."), (2, 2, "user", "what is this?", "what is this?"), (2, 3, "user", "and then?", "and then?"),
]
_SAID = [
    ("I could not find anything related to your query, sorry.", True), ("There is no mention of salt.", True), ("The passages DO NOT contain the date!", True), ("The text doesn't contain it", False), ("It is 'not mentioned' in the passages.", True), ("No information, about tolls.", True),
    ("I cannot answer based on this.", True), ("Salt was not found in the passages", True), ("Salt was not found in the old passage.", False), ("The harbour does contain salt.", False), ("The barrel does not contain salt.", True), ("", False),
]
#: answer, context, sources, is a refusal, and: support, is a stub, passes.
_JUDGED = [
    ("The harbour was dug by convicts over nine winters, and salt left the quay each spring after that work.", "Convicts dug the harbour over nine winters. Salt left the quay each spring; that work paid.", 1, False, 1.0, False, True),
    ("Convicts built four bridges.", "Convicts dug the harbour.", 2, False, 0.25, True, False),
    ("Salt, timber, wool, fish, grain", "salt timber wool fish and much more", 1, False, 0.8, True, True),
    ("Salt, timber, wool, fish, grain", "salt timber wool fish and much more", 0, False, 0.8, True, False),
    ("It is so.", "anything", 1, False, 1.0, True, True),
    ("Nothing there.", "anything", 0, True, 0.0, True, True),
    ("The quay holds these things that were left behind by the last boat of the year:", "quay holds things left behind last boat year", 1, False, 1.0, True, True),
]
_TEXT = "The quay was raised twice in its first century, and each time the stone came down the river by barge from the same hill. "
#: page, links: a start with siblings and others, machinery, a page without text, and a loop.
_GRAPH = {
    "/town/quay": ("/mill", "/town/lock", "/login", "/town/weir?utm_source=a", "/town/quay"), "/town/lock": ("/town/tolls", "/mill", "/town/short"), "/town/weir": ("/town/tolls", "/fish"), "/mill": ("/wheel",), "/town/tolls": ("/town/ferry",), "/town/short": ("/lost",),
    "/fish": (), "/wheel": ("/town/late",), "/town/ferry": (), "/town/late": (), "/lost": (), "/login": (),
}
_REACHED = ["/town/quay", "/town/lock", "/town/weir", "/mill", "/town/tolls", "/fish", "/wheel", "/town/ferry"]


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fixture_line_verdicts(spark, sf_dir):
    """Closing apparatus, contents and citations, line by line."""
    return clean.line_verdicts(_rows(spark, _CLEAN, "case_id string, text string"), "case_id").select("case_id", "line_no", "verdict")


def fixture_cleaned_text(spark, sf_dir):
    return clean.cleaned(_rows(spark, _CLEAN, "case_id string, text string")).select("case_id", "cleaned")


def fixture_links(spark, sf_dir):
    """Resolution and eligibility of links, those from a start on site machinery last."""
    rows = [(i, h, _AT, "/town/quay") for i, (h, _) in enumerate(_LINKS)] + [(100 + i, h, _AT, "/login") for i, (h, _) in enumerate(_STARTED)]
    return _rows(spark, rows, "case_no int, href string, at string, start string").select("case_no", u.eligible(F.col("href"), F.col("at"), F.col("start")).alias("target"))


def fixture_disambiguation(spark, sf_dir):
    rows = _rows(spark, [(i, t, x) for i, (t, x, _) in enumerate(_PAGES)], "case_no int, title string, text string")
    return rows.select("case_no", u.is_disambiguation(F.col("title"), F.col("text")).alias("is_disambiguation"))


def fixture_long_intent(spark, sf_dir):
    rows = _rows(spark, [(i, q) for i, (q, _, _) in enumerate(_ASKED)], "case_no int, question string")
    return rows.select("case_no", g.wants_long(F.col("question")).alias("is_long"), g.parameters(F.col("question"))["k"].alias("k"))


def fixture_followup(spark, sf_dir):
    return g.resolved(_rows(spark, [r[:4] for r in _TALK], "conv_id int, turn int, role string, text string")).select("conv_id", "turn", "query")


def fixture_refusal(spark, sf_dir):
    rows = _rows(spark, [(i, t) for i, (t, _) in enumerate(_SAID)] + [(99, a.REFUSAL)], "case_no int, answer string")
    return rows.select("case_no", a.is_refusal(F.col("answer")).alias("is_refusal"))


def fixture_answer_eval(spark, sf_dir):
    rows = _rows(spark, [(i, *r[:4]) for i, r in enumerate(_JUDGED)], "case_no int, answer string, context string, n_sources int, refusal boolean")
    rows = rows.withColumn("support", a.support(F.col("answer"), F.col("context")))
    return rows.select("case_no", F.round("support", 6).alias("support"), a.is_stub(F.col("answer")).alias("is_stub"), a.passes(F.col("refusal"), F.col("n_sources"), F.col("support")).alias("passes"))


def fixture_crawl(spark, sf_dir):
    """A crawl of eight pages: siblings of the start first, machinery and a page without text passed over."""
    site = "http://port.example"
    rows = [(site + p, p, "Short." if p == "/town/short" else _TEXT + p, list(links)) for p, links in _GRAPH.items()]
    found = crawl.crawl(_rows(spark, rows, "url string, title string, text string, links array<string>"), site + "/town/quay", 8)
    return _rows(spark, [(i, r.url) for i, r in enumerate(found)], "turn int, url string")


def _values(names: str, rows: list[tuple], types: str = "") -> str:
    """SQL of stated rows."""
    def one(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


def _text_of(case: str) -> str:
    lines = dict(_CLEAN)[case].split("\n")
    return "\n".join(lines[i] for c, i, v in _VERDICTS if c == case and v == "kept")


QUERIES = {f.__name__: f for f in (fixture_line_verdicts, fixture_cleaned_text, fixture_links, fixture_disambiguation, fixture_long_intent, fixture_followup, fixture_refusal, fixture_answer_eval, fixture_crawl)}
ORACLES = {
    "fixture_line_verdicts": _values("case_id, line_no, verdict", _VERDICTS),
    "fixture_cleaned_text": _values("case_id, cleaned", [(c, _text_of(c)) for c, _ in _CLEAN]),
    "fixture_links": _values("case_no, target", [(i, t) for i, (_, t) in enumerate(_LINKS)] + [(100 + i, t) for i, (_, t) in enumerate(_STARTED)]),
    "fixture_disambiguation": _values("case_no, is_disambiguation", [(i, w) for i, (_, _, w) in enumerate(_PAGES)]),
    "fixture_long_intent": _values("case_no, is_long, k", [(i, *r[1:]) for i, r in enumerate(_ASKED)]),
    "fixture_followup": _values("conv_id, turn, query", [(r[0], r[1], r[4]) for r in _TALK]),
    "fixture_refusal": _values("case_no, is_refusal", [(i, w) for i, (_, w) in enumerate(_SAID)] + [(99, True)]),
    "fixture_answer_eval": _values("case_no, support, is_stub, passes", [(i, *r[4:]) for i, r in enumerate(_JUDGED)]),
    "fixture_crawl": _values("turn, url", [(i, "http://port.example" + p) for i, p in enumerate(_REACHED)]),
}
