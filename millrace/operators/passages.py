"""Cleaning and chunking in one Arrow pass: the rules of ``clean`` and ``chunk`` in Python, for whole builds, where interpreted array expressions cost several times as much.

Results equal those of the expressions, character by character (tested). A text is handled alone, in time proportional to its length; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import SPACES, TERMINAL, TOKEN, WS, plain
from ..session import small_batches
from . import chunk, clean
from .bpe import packed

#: Chunks that are handed on at once.
ROWS = 1000

_find = lambda pattern: re.compile(plain(pattern), re.ASCII).search
_all = lambda pattern: re.compile(plain(pattern), re.ASCII).findall
_sub = lambda pattern: re.compile(plain(pattern), re.ASCII).sub
_WHITE = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{plain(WS)}]", c))
_runs, _token, _terminal, _stop, _full_stop = _all(SPACES), _all(TOKEN), _find(TERMINAL), _find("[.!?]$"), _find("[.!]$")
_sentences, _heading, _verb, _capitals = _all(chunk.SENTENCE), _sub(chunk.HEADING), _find(chunk.VERB), _all(chunk.CAPITAL)
_blanks, _edit, _tail, _tail_sub = _sub("[ \\t]+"), _sub(clean.EDIT), _find(clean.TAIL_HEADING), _find(clean.TAIL_SUBHEADING)
_numbered, _number, _markers, _ranges, _digit, _decimal = _find(clean.NUMBERED), _sub(clean.SECTION_NUMBER), _all(clean.MARKER), _all(clean.PAGE_RANGE), _find("[0-9]"), _find("[0-9]\\.[0-9]")
_breaks, _gaps = _sub("\\n{3,}"), re.compile("\\n{2,}").split
_boilerplate, _citation = ([(clean.NEEDS.get(p, ("",)), _find(p)) for p in ps] for ps in (clean.BOILERPLATE, clean.CITATION))


def _words(x: str) -> int:
    return 1 + len(_runs(x))


def _any(x: str, low: str, patterns: list) -> bool:
    return any(found(x) for needs, found in patterns if any(n in low for n in needs))


def _contents(x: str) -> bool:
    if _numbered(x):
        body = _number("", x)
        if not (_full_stop(body) or _words(body) > 9):
            return True
    if not _decimal(x):
        return False
    markers = len(_markers(x))
    return markers >= 3 and not _full_stop(x) and _words(x) <= 6 * markers


def cleaned(text: str) -> str:
    """The text that ``clean.cleaned`` makes."""
    kept, seen, tail = [], set(), False
    for line in text.split("\n"):
        line = _blanks(" ", line.replace("\xa0", " ")).strip(_WHITE)
        heading = line.startswith("## ")
        own = line[3:] if heading else line
        if heading:
            name = _edit("", own).strip(_WHITE)
            tail = True if _tail(name) else tail if _tail_sub(name) else False
        if tail:
            continue
        if line:
            low = own.lower()
            if _any(own, low, _boilerplate) or _contents(own):
                continue
            if not heading and (len(own) < 3 or _any(own, low, _citation) or (_digit(own) and len(_ranges(own)) >= 3)):
                continue
            if low in seen:
                continue
            seen.add(low)
        kept.append(line)
    return _breaks("\n\n", "\n".join(kept)).strip(_WHITE)


def windows(ceiling: int) -> Callable[[str], list[str]]:
    """What cuts a text into windows of ``ceiling`` tokens."""
    return _all(chunk.window(ceiling))


def units(text: str, ceiling: int, cut: Callable[[str], list[str]]) -> list[tuple[str, int]]:
    """(text, tokens) of each unit, as ``chunk.units`` makes them; ``cut`` is ``windows`` of the ceiling."""
    out = []
    for paragraph in _gaps(text):
        paragraph = paragraph.replace("\n", " ").strip(_WHITE)
        if not paragraph:
            continue
        n = len(_token(paragraph))
        if n <= ceiling:
            out.append((paragraph, n))
            continue
        for sentence in [s for x in _sentences(paragraph) if (s := x.strip(_WHITE))] or [paragraph]:
            n = len(_token(sentence))
            if n <= ceiling:
                out.append((sentence, n))
            else:
                out += [(w, len(_token(w))) for x in cut(sentence) if (w := x.strip(_WHITE))]
    return out


def _bare(x: str) -> str:
    return _heading("", x)


def refined(chunks: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(text, tokens) of the chunks that ``chunk.refined`` leaves. Neighbours share lines, so a line is judged once."""

    @cache
    def prose(x: str) -> bool:
        return bool(_terminal(x)) and _words(x) >= 8

    @cache
    def listing(line: str) -> bool:
        b = _bare(line).strip(_WHITE)
        if not b or prose(b):
            return not b
        if not _stop(b) and not _verb(b):
            return True
        n = _words(b)
        return n >= 3 and 5 * len(_capitals(b)) >= 3 * n

    @cache
    def bare(x: str) -> str:
        return _bare(x)

    words, tokens = cache(_words), cache(lambda x: len(_token(x)))

    def answers(lines: list[str]) -> bool:
        own = [b for x in lines if (b := bare(x).strip(_WHITE))]
        total = sum(map(words, own))
        if total < 25:
            return any(map(_terminal, own))
        said = [b for b in own if prose(b)]
        return bool(said) and 50 * sum(map(words, said)) >= 17 * total and 2 * sum(map(listing, own)) <= len(own)

    out = []
    for text, _ in chunks:
        raw = text.split("\n")
        if not answers(raw):
            continue
        lines = [x.strip(_WHITE) for x in raw]
        begin = next((i for i, x in enumerate(lines) if prose(bare(x)) or (x.startswith("## ") and prose(lines[i + 1] if i + 1 < len(lines) else " "))), 0)
        lines = [x for x in lines[begin:] if x]
        lines = [x for i, x in enumerate(lines) if prose(bare(x)) or (x.startswith("## ") and prose(bare(lines[i + 1] if i + 1 < len(lines) else " "))) or not listing(x)]
        n = sum(map(tokens, lines))
        if lines and (n >= 8 or _terminal(lines[-1])):
            out.append(("\n".join(lines), n))
    return out


def built(pages: DataFrame, keep: list[str], text_col: str = "text", chunk_tokens: int = chunk.CHUNK_TOKENS, overlap_tokens: int = chunk.OVERLAP_TOKENS, clean_first: bool = True, texts: bool = True) -> DataFrame:
    """One row per refined chunk: ``keep``, chunk_index (contiguous from 0), text if ``texts``, token_count. The texts are cleaned first, or with ``clean_first`` off are so already."""
    if overlap_tokens >= chunk_tokens:
        raise ValueError("overlap_tokens must be smaller than chunk_tokens")
    small_batches(pages.sparkSession)
    rows = pages.select(*keep, text_col)
    ceiling = max(1, chunk_tokens // 2)
    cut = windows(ceiling)
    columns = {"chunk_index": pa.int32(), "text": pa.string(), "token_count": pa.int32()}

    def handed(batch: pa.RecordBatch, at: list, index: list, said: list, tokens: list) -> pa.RecordBatch:
        made = {"chunk_index": index, **({"text": said} if texts else {}), "token_count": tokens}
        own = batch.take(pa.array(at, pa.int32())).columns[: len(keep)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(v, columns[k]) for k, v in made.items())], [*keep, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, said, tokens = held = [], [], [], []
            for i, text in enumerate(batch.column(len(keep))):
                text = text.as_py() or ""
                for j, (t, n) in enumerate(refined(packed(units(cleaned(text) if clean_first else text, ceiling, cut), chunk_tokens, overlap_tokens))):
                    at.append(i)
                    index.append(j)
                    if texts:
                        said.append(t)
                    tokens.append(n)
                    if len(at) == ROWS:
                        yield handed(batch, *held)
                        for x in held:
                            x.clear()
            if at:
                yield handed(batch, *held)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{types}, chunk_index int, {'text string, ' if texts else ''}token_count int")
