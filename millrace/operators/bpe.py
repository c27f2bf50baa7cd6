"""Token counts, truncation and chunks by a BPE vocabulary file, in place of the additive pattern of ``functions.text``.

A vocabulary cannot be expressed in SQL, so texts pass through Arrow batches; units and packing follow the same rules as ``chunk.with_chunks``. The file's path is a parameter
and is read by each worker, so it must be where all workers see it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS
from .chunk import CHUNK_TOKENS, OVERLAP_TOKENS, SENTENCE

_CLASS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
_SENTENCE = re.compile(SENTENCE.replace(WS, _CLASS))
_ENDS = re.compile(f"^[{_CLASS}]+|[{_CLASS}]+$")


@cache
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def offsets(path: str, text: str) -> list[tuple[int, int]]:
    """Where each token of a text lies, in code points."""
    return _vocabulary(path).encode(text, add_special_tokens=False).offsets if text else []


def counted(text: str, path: str) -> Column:
    """Token count of a text column; 0 for null and empty."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(offsets(path, t or "")))

    return count(text)


def truncated(text: str, path: str, most: int) -> Column:
    """The text up to the end of its token number ``most``; unchanged if it has no more."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            at = offsets(path, t or "")
            return t if len(at) <= most else t[: at[most - 1][1]] if most else ""

        return texts.map(one)

    return cut(text)


def units(text: str, path: str, chunk_tokens: int) -> list[tuple[str, int]]:
    """(text, tokens): paragraphs, or for long ones their sentences, or for long ones token windows; at most half a chunk each."""
    ceiling, out = max(1, chunk_tokens // 2), []
    stripped = lambda t: _ENDS.sub("", t)
    for paragraph in filter(None, (stripped(p.replace("\n", " ")) for p in re.split(r"\n{2,}", text))):
        n = len(offsets(path, paragraph))
        if n <= ceiling:
            out.append((paragraph, n))
            continue
        for sentence in [s for s in map(stripped, _SENTENCE.findall(paragraph)) if s] or [paragraph]:
            at = offsets(path, sentence)
            if len(at) <= ceiling:
                out.append((sentence, len(at)))
                continue
            for begin in range(0, len(at), ceiling):
                own = at[begin : begin + ceiling]
                if window := stripped(sentence[own[0][0] : own[-1][1]]):
                    out.append((window, len(own)))
    return out


def packed(own: list[tuple[str, int]], chunk_tokens: int, overlap_tokens: int, drop_short_tail: bool = True) -> list[tuple[str, int]]:
    """Units in chunks of at most ``chunk_tokens``, each carrying the tail of the one before up to ``overlap_tokens``, never all of it."""
    sums = [0]
    for _, n in own:
        sums.append(sums[-1] + n)
    start, cuts = 0, []
    for i in range(len(own)):
        if i > start and sums[i + 1] - sums[start] > chunk_tokens:
            cuts.append((start, i))
            back = i
            while back - 1 > start and sums[i] - sums[back - 1] <= overlap_tokens:
                back -= 1
            start = back
    if len(own) > start and (not cuts or not drop_short_tail or sums[-1] - sums[start] > overlap_tokens):
        cuts.append((start, len(own)))
    return [("\n".join(t for t, _ in own[a:b]), sums[b] - sums[a]) for a, b in cuts]


def with_chunks(pages: DataFrame, path: str, text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, drop_short_tail: bool = True) -> DataFrame:
    """Add ``chunks``, an array of (text, tokens) by the vocabulary at ``path``. Null and blank texts have none."""
    if overlap_tokens >= chunk_tokens:
        raise ValueError("overlap_tokens must be smaller than chunk_tokens")
    kept = pages.drop("chunks")
    at = kept.columns.index(text_col)
    form = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"text": t, "tokens": n} for t, n in packed(units(x or "", path, chunk_tokens), chunk_tokens, overlap_tokens, drop_short_tail)] for x in batch.column(at).to_pylist()]
            yield batch.append_column("chunks", pa.array(found, form))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, types + ", chunks array<struct<text: string, tokens: int>>")
