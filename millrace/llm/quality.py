"""Line-first quality cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SYMBOLS = b"#*$%&|<>"
#: Menu separators, as UTF-8: vertical bar, double and single right angle quote, middle dot, bullet.
SEPARATORS = r"\||»|›|·|•"
#: Sentence and clause marks of Latin and CJK text, as UTF-8.
MARKS = r"""[.,;:!?"')\]]|…|。|、|，|！|？|»|”|’"""
#: Phrases of page furniture; they count on lines of at most MOST_BOILERPLATE_WORDS words.
BOILERPLATE = (
    r"^[^a-z0-9]*(copyright|©|\(c\) [0-9]{4})|all rights reserved|lorem ipsum|(enable|requires?) javascript|"
    r"(accept|reject|manage|use[sd]?|our) (all )?cookies?|cookie (policy|settings|preferences)|privacy (policy|settings)|terms (of (use|service)|and conditions)|"
    r"(subscribe|sign up) (to|for) (our|the) newsletter|(follow|like) us on|click here|back to top|skip to (main )?content|"
    r"licensed under|spdx-license-identifier|permission is hereby granted|without warrant(y|ies) (or conditions )?of any kind"
)
MOST_BOILERPLATE_WORDS = 30
LEAST_WORDS, MOST_REPEATED_PERCENT, MOST_LOST_PERCENT = 50, 50, 50
#: A line is a menu when it has two separators and at least one for every so many words; it is noise when over one symbol falls on so many words.
WORDS_PER_SEPARATOR, WORDS_PER_SYMBOL, LEAST_UNMARKED_WORDS = 6, 4, 4


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, where, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def judge_line(line: bytes, n_words: int, boilerplate: re.Pattern, separators: re.Pattern, marks: re.Pattern) -> str | None:
    """The rule that a line with words fails, or None: navigation, boilerplate or punctuation, in this order."""
    bars = len(separators.findall(line))
    if bars >= 2 and bars * WORDS_PER_SEPARATOR >= n_words:
        return "navigation"
    if n_words <= MOST_BOILERPLATE_WORDS and boilerplate.search(line.lower()):
        return "boilerplate"
    if (len(line) - len(line.translate(None, SYMBOLS))) * WORDS_PER_SYMBOL > n_words:
        return "punctuation"
    if n_words < LEAST_UNMARKED_WORDS and not marks.search(line):
        return "punctuation"
    return None


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    boilerplate, separators, marks = (re.compile(p.encode()) for p in (BOILERPLATE, SEPARATORS, MARKS))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_navigation", "n_boilerplate", "n_punctuation", "lost_chars"]
    for batch in batches:
        out: dict[str, list] = {x: [] for x in names}
        failed_base, kept, texts = [], [], []
        for value in batch.column(1):
            text = value.as_py()
            data = (text or "").encode()
            words = data.split()
            chars = len(b"".join(words).decode())
            seen: set[bytes] = set()
            good, lost, again = [], 0, 0
            failed = dict.fromkeys(("navigation", "boilerplate", "punctuation"), 0)
            for line in data.split(b"\n"):
                own = line.split()
                if own:
                    if line in seen:
                        again += 1
                        why = "boilerplate"
                    else:
                        seen.add(line)
                        why = judge_line(line, len(own), boilerplate, separators, marks)
                    if why:
                        failed[why] += 1
                        lost += len(b"".join(own).decode())
                        continue
                good.append(line)
            repeats = repeated_words(words)
            bad = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            for name, x in zip(names, (len(words), chars, symbols, again, repeats, *failed.values(), lost), strict=True):
                out[name].append(x)
            failed_base.append(bad)
            kept.append(not bad and 100 * lost <= MOST_LOST_PERCENT * chars)
            texts.append(None if text is None else b"\n".join(good).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[x], pa.int64()) for x in names[:5]), pa.array(failed_base), pa.array(kept), *(pa.array(out[x], pa.int64()) for x in names[5:]), pa.array(texts, pa.string())],
            ["key", *names[:5], "base_failed", "kept", *names[5:], "cleaned"],
        )


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, the counts and verdicts, the cleaned text in ``cleaned``, and the ``carry`` columns.

    Words are runs of non-white-space. base_failed: fewer than 50 words, or over half of them in repeated three-word
    windows. A line fails when it is a menu, short page furniture or a copy of an earlier line, symbol noise, or a fragment without any
    mark. kept is false when base_failed, or when failing lines hold over half of the word characters. A null
    text has no words and stays null; an empty text is failed; blank lines are kept as they are. Rows are judged alone, so repeated rows, null
    ids and ties need no rule; an empty table gives an empty result. Columns beyond those named are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    counts = ", ".join(f"{x} long" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    more = ", ".join(f"{x} long" for x in ("n_navigation", "n_boilerplate", "n_punctuation", "lost_chars"))
    schema = f"key {keyed.schema['key'].dataType.simpleString()}, {counts}, base_failed boolean, kept boolean, {more}, cleaned string"
    judged = keyed.mapInArrow(_clean, schema)
    return judged.select(F.col("key.id").alias(id_col), *judged.columns[1:], *[F.col(f"key.c{i}").alias(c) for i, c in enumerate(carry)])


def oracle() -> str:
    """The rows of the query in DuckDB SQL, for a table of distinct ids."""
    word = r"'[^\x20\x09-\x0D]+'"
    q = lambda p: "'" + p.replace("'", "''") + "'"
    symbols = "'[#*$%&|<>]'"
    return rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {word}) w from documents),
p as (select doc_id, unnest(w) x, unnest(range(0, len(w))) i from d),
g as (select doc_id, i, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o s from p window o as (partition by doc_id order by i)),
r as (select doc_id, i from g where s is not null qualify count(*) over (partition by doc_id, s) > 1),
c as (select doc_id, count(*) n_repeat_words from (select doc_id, i from r union select doc_id, i + 1 from r union select doc_id, i + 2 from r) group by 1),
u as (select doc_id, string_split(t, chr(10)) ls from d),
e as (select doc_id, unnest(ls) line, unnest(range(0, len(ls))) no from u),
l as (select *, regexp_extract_all(line, {word}) lw from e where regexp_matches(line, {word})),
f as (select *, len(lw) n, length(array_to_string(lw, '')) chars, row_number() over (partition by doc_id, line order by no) > 1 again,
    len(regexp_extract_all(line, {q(SEPARATORS)})) bars, length(line) - length(regexp_replace(line, {symbols}, '', 'g')) sy from l),
v as (select *, case when again then 'b' when bars >= 2 and bars * {WORDS_PER_SEPARATOR} >= n then 'n' when n <= {MOST_BOILERPLATE_WORDS} and regexp_matches(lower(line), {q(BOILERPLATE)}) then 'b'
    when sy * {WORDS_PER_SYMBOL} > n then 'p' when n < {LEAST_UNMARKED_WORDS} and not regexp_matches(line, {q(MARKS)}) then 'p' else '' end why from f),
s as (select doc_id, count_if(again) n_dup_lines, count_if(why = 'n') n_navigation, count_if(why = 'b') n_boilerplate, count_if(why = 'p') n_punctuation, cast(coalesce(sum(chars) filter (why <> ''), 0) as bigint) lost_chars from v group by 1),
b as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(regexp_replace(t, {symbols}, '', 'g')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
    coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_navigation, 0) n_navigation, coalesce(n_boilerplate, 0) n_boilerplate, coalesce(n_punctuation, 0) n_punctuation, coalesce(lost_chars, 0) lost_chars
    from d left join c using (doc_id) left join s using (doc_id))
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) and 100 * lost_chars <= {MOST_LOST_PERCENT} * word_chars kept from b
"""
