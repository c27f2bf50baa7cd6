"""Line cleaning of page texts: every rule is an array expression over a text's lines, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import duck, duck_any, duck_has, duck_trimmed, duck_words, exploded, has, let, lit, n_words, trimmed, SPACES

#: Lines that are page furniture.
BOILERPLATE = (
    r"(?i)^(copyright|©|all rights reserved)",
    r"(?i)^(accept|manage|reject)( all)? cookies?",
    r"(?i)^(privacy policy|terms of (use|service)|cookie policy)$",
    r"(?i)^(share|follow us|subscribe|sign (in|up)|log ?in|register)$",
    r"(?i)^(skip to (main )?content|back to top|read more|learn more)$",
    r"(?i)^(home|menu|search|previous|next)$",
    r"(?i)\bcookies?\b.*\b(enhance|improve|experience|necessary|function|analytics|consent|preferences)\b",
    r"(?i)\b(essential|analytics|marketing|functional) cookies?\b",
    r"(?i)\bwe use cookies?\b",
    r"(?i)\byour (privacy|consent) (choices|preferences|settings)\b",
    r"(?i)\b(newsletter|mailing list)\b.*\b(sign ?up|subscribe|join)\b",
)
#: Headings of closing apparatus, and headings that stay inside it.
TAIL_HEADING = (
    r"(?i)^(references?|external links?|further reading|see also|notes?|citations?|bibliography|sources?|footnotes?|works cited|in popular culture|popular culture|in fiction|media|gallery|"
    r"gallery of images|gallery of|awards?|honours?|honors?|related pages?|navigation|contents?)$"
)
TAIL_SUBHEADING = (
    r"(?i)^(films?|movies?|television|tv|theatre|theater|literature|novels?|books?|poetry|music|folk music|songs?|games?|video games?|comics?|art|paintings?|documentaries|radio|adaptations?|"
    r"references in|depictions?|portrayals?|in media|primary sources?|secondary sources?|tertiary sources?|text-?books?( and academic monographs)?|articles? in journals?( and collections?)?|"
    r"academic monographs?|other histories|first person accounts?( and classic histories)?|historiography( and memory)?|online books?|archives?|manuscripts?)$"
)
#: Bibliographic lines.
CITATION = (
    r"(?i)\b(isbn|issn|doi|oclc|jstor|arxiv)\b",
    r"(?i)\{\{cite\b",
    r"(?i)\bretrieved\s+\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)\barchived from the original\b",
    r"\([A-Z][\w\s.]*:\s*[^)]*,\s*(19|20)\d{2}\)",
)
#: What a line must contain, in lower case, for a pattern to be worth matching; the others are anchored or cheap.
NEEDS = {
    BOILERPLATE[6]: ("cookie",),
    BOILERPLATE[7]: ("cookie",),
    BOILERPLATE[8]: ("cookie",),
    BOILERPLATE[9]: ("your ",),
    BOILERPLATE[10]: ("newsletter", "mailing list"),
    CITATION[0]: ("isbn", "issn", "doi", "oclc", "jstor", "arxiv"),
    CITATION[1]: ("{{cite",),
    CITATION[2]: ("retrieved",),
    CITATION[3]: ("archived from the original",),
    CITATION[4]: ("19", "20"),
}
PAGE_RANGE = r"\b\d{1,4}\s*[-–]\s*\d{0,4}"
SECTION_NUMBER = r"^[A-Z]?\d+(\.\d+)*\.?\s+"
NUMBERED = r"^[A-Z]?\d+(\.\d+)*\.?\s+\S"
MARKER = r"\b[A-Z]?\d+\.\d+\b"
EDIT = r"(?i)\s*\[edit\]\s*$"


def _any_of(x: str, low: str, patterns: tuple[str, ...]) -> str:
    def one(p: str) -> str:
        needs = " OR ".join(f"contains({low}, '{n}')" for n in NEEDS.get(p, ()))
        return f"(({needs}) AND {has(x, p)})" if needs else has(x, p)

    return "(" + " OR ".join(map(one, patterns)) + ")"


def _contents(x: str) -> str:
    body = f"regexp_replace({x}, {lit(SECTION_NUMBER)}, '')"
    label = f"({has(x, NUMBERED)} AND NOT ({has(body, '[.!]$')} OR {n_words(body)} > 9))"
    markers = f"regexp_count({x}, {lit(MARKER)})"
    return f"({label} OR (contains({x}, '.') AND {markers} >= 3 AND NOT {has(x, '[.!]$')} AND {n_words(x)} <= 6 * {markers}))"


def _cites(x: str, low: str) -> str:
    return f"({_any_of(x, low, CITATION)} OR ({x} rlike '[0-9]' AND regexp_count({x}, {lit(PAGE_RANGE)}) >= 3))"


def with_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``lines``: per line of the text a struct of line (normalised), plain (without a heading mark), heading, and verdict.

    Verdicts, the first that applies: tail (inside closing apparatus, its heading included), blank (kept), boilerplate, contents, citation, tiny, duplicate, kept. Only headings and lines up to
    ``tiny`` take part in duplicates, case folded. A null text has no lines. Sub-headings leave the tail state as it is; another heading ends it.
    The work grows with the lines of a text, times the logarithm of their number.
    """
    line = trimmed(f"regexp_replace(regexp_replace(l, '\\u00a0', ' '), '[ \\\\t]+', ' ')")
    name = trimmed(f"regexp_replace(f.plain, {lit(EDIT)}, '')")
    marked = f"transform(transform(split({text_col}, '\\n'), l -> {line}), l -> named_struct('line', l, 'heading', startswith(l, '## '), 'plain', IF(startswith(l, '## '), substr(l, 4), l)))"
    kind = let("t", name, f"CASE WHEN {has('t', TAIL_HEADING)} THEN 1 WHEN {has('t', TAIL_SUBHEADING)} THEN 2 ELSE 3 END")
    event = f"IF(f.heading, {kind}, 0)"
    own = (
        f"CASE WHEN f.line = '' THEN 'blank' WHEN {_any_of('f.plain', 'low', BOILERPLATE)} THEN 'boilerplate' WHEN {_contents('f.plain')} THEN 'contents'"
        f" WHEN NOT f.heading AND {_cites('f.plain', 'low')} THEN 'citation' WHEN NOT f.heading AND char_length(f.plain) < 3 THEN 'tiny' ELSE 'kept' END"
    )
    own = let("low", "lower(f.plain)", own)
    facts = f"transform({marked}, f -> named_struct('line', f.line, 'plain', f.plain, 'heading', f.heading, 'event', {event}, 'own', {own}))"
    # A line is in the tail if the last event at or before it opened one: in a string of events, a 0 that only 0s part from a 1 before it becomes a 1.
    events = "array_join(transform(facts, f -> CASE f.event WHEN 1 THEN '1' WHEN 3 THEN '3' ELSE '0' END), '')"
    tail = rf"split(regexp_replace({events}, r'(?:(?!\A)\G|(?<=1))0', '1'), '')"
    # Lines sorted by key: the first of each key stays; sorted back by line, a flag stands at each line's place.
    keyed = "array_sort(transform(facts, (f, i) -> named_struct('key', IF(f.own = 'kept' AND get(tail, i) <> '1', lower(f.plain), NULL), 'i', i)))"
    again = let("sorted", keyed, "transform(array_sort(transform(sorted, (x, j) -> named_struct('i', x.i, 'again', x.key IS NOT NULL AND coalesce(get(sorted, j - 1).key = x.key, false)))), x -> x.again)")
    verdict = "CASE WHEN get(tail, i) = '1' THEN 'tail' WHEN get(again, i) THEN 'duplicate' ELSE f.own END"
    judged = f"transform(facts, (f, i) -> named_struct('line', f.line, 'plain', f.plain, 'heading', f.heading, 'verdict', {verdict}))"
    return pages.withColumn("lines", F.expr(let("facts", facts, let("tail", tail, let("again", again, judged)))))


def line_verdicts(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line_no (from 0), line, heading, verdict."""
    return exploded(with_lines(pages, text_col), [id_col], "lines", "line_no", "x").select(id_col, "line_no", "x.line", "x.heading", "x.verdict")


def cleaned(pages: DataFrame, text_col: str = "text", into: str = "cleaned") -> DataFrame:
    """Add the cleaned text: kept lines, at most one blank line between them, ends trimmed. Null stays null."""
    joined = "array_join(transform(filter(lines, f -> f.verdict IN ('kept', 'blank')), f -> f.line), '\\n')"
    return with_lines(pages, text_col).withColumn(into, F.expr(trimmed(f"regexp_replace({joined}, '\\n{{3,}}', '\\n\\n')"))).drop("lines")


def oracle_lines() -> str:
    """DuckDB CTEs that end in ``v``: doc_id, line_no, line, heading, verdict."""
    name = duck_trimmed(f"regexp_replace(plain, {duck(EDIT)}, '')")
    body = f"regexp_replace(plain, {duck(SECTION_NUMBER)}, '')"
    markers = f"len(regexp_extract_all(plain, {duck(MARKER)}))"
    toc = (
        f"(({duck_has('plain', NUMBERED)} and not ({duck_has(body, '[.!]$')} or {duck_words(body)} > 9))"
        f" or ({markers} >= 3 and not {duck_has('plain', '[.!]$')} and {duck_words('plain')} <= 6 * {markers}))"
    )
    cites = f"({duck_any('plain', CITATION)} or len(regexp_extract_all(plain, {duck(PAGE_RANGE)})) >= 3)"
    line = duck_trimmed("regexp_replace(replace(l, chr(160), ' '), '[ \\t]+', ' ', 'g')")
    return f"""
with s as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
e as (select doc_id, unnest(ls) l, cast(unnest(range(0, len(ls))) as int) line_no from s),
n as (select doc_id, line_no, {line} line from e),
h as (select *, starts_with(line, '## ') heading, case when starts_with(line, '## ') then line[4:] else line end plain from n),
w as (select *, last_value(case when not heading then null when {duck_has(name, TAIL_HEADING)} then 1 when {duck_has(name, TAIL_SUBHEADING)} then null else 0 end ignore nulls)
      over (partition by doc_id order by line_no rows unbounded preceding) tail from h),
o as (select *, case when coalesce(tail, 0) = 1 then 'tail' when line = '' then 'blank' when {duck_any('plain', BOILERPLATE)} then 'boilerplate' when {toc} then 'contents'
      when not heading and {cites} then 'citation' when not heading and length(plain) < 3 then 'tiny' else 'kept' end own from w),
v as (select doc_id, line_no, line, heading, plain, case when own = 'kept' and row_number() over (partition by doc_id, own, lower(plain) order by line_no) > 1 then 'duplicate' else own end verdict from o)
"""


def oracle_cleaned() -> str:
    """DuckDB CTEs that end in ``c``: doc_id, cleaned."""
    return oracle_lines() + f""", c as (select doc_id, {duck_trimmed("regexp_replace(string_agg(line, chr(10) order by line_no), '\\n{3,}', chr(10) || chr(10), 'g')")} cleaned
from v where verdict in ('kept', 'blank') group by doc_id)
"""
