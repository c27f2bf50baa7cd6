"""Language identification by cross-parsing: the language whose sample explains a text in the fewest longest matches wins.

Method. For each language a suffix automaton of sampled labelled text is built. A text is parsed greedily into phrases, each the longest match
that occurs in the sample; a text in the sample's language needs fewer, longer phrases. The phrase count times log2 of the sample's length, per
character, estimates the cross entropy; the least wins. Texts are letters, case folded, with single separators between runs of letters.
The automaton becomes a table of (state, letter) to next state with the start of a phrase marked, so that numpy parses all segments of a batch of texts in step. A letter that a sample lacks is a phrase by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, prepare

UNDETERMINED = "und"
#: Bounds of the sample: documents a language, characters of each, and characters a language.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 64, 4000, 30_000
#: Entries of a language's step table (4 bytes each); a larger one is kept as sorted keys.
DENSE = 1 << 23
#: Texts are parsed in segments of so many characters, so that long ones bound no batch; each adds one phrase at most.
SEGMENT = 2048


def letter_codes(texts: list[str]) -> tuple[np.ndarray, int]:
    """A code for each code point: 0 for what is no letter, 1 for letters in no sample, others from 2 by case-folded letter; and the number of codes."""
    codes = np.array([c.isalpha() for c in map(chr, range(0x110000))], np.uint16)
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    for k, c in enumerate(letters, 2):
        for x in (c, c.upper()):
            if len(x) == 1:
                codes[ord(x)] = k
    return codes, len(letters) + 2


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    """The codes of a text, runs of non-letters as one 0."""
    x = codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    if not len(x):
        return x
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    return x[keep]


def automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a code sequence; state 0 is the start, and every factor of the sequence leads somewhere from it."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence.tolist():
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return goto


class Parser:
    """Steps of greedy longest-match parsing against one sample.

    State 0 is between phrases: it is where a parse starts, and where a letter leads that the sample lacks, which is a phrase by itself. The automaton's states follow.
    Up to DENSE entries the steps are a table of state and letter; a language of many letters has its steps as sorted keys, so that memory grows with the sample alone.
    """

    def __init__(self, goto: list[dict[int, int]], n_codes: int, dense: int | None = None):
        self.n = n_codes
        start = np.zeros(n_codes, np.int64)
        for c, t in goto[0].items():
            start[c] = t + 1
        if (len(goto) + 1) * n_codes <= (DENSE if dense is None else dense):
            table = np.tile(start * n_codes * 2 + 1, (len(goto) + 1, 1))
            for s, row in enumerate(goto, 1):
                for c, t in row.items():
                    table[s, c] = (t + 1) * n_codes * 2
            self.table, self.keys = table.astype(np.int32).ravel(), None
        else:
            steps = sorted((s * n_codes + c, t + 1) for s, row in enumerate(goto, 1) for c, t in row.items())
            self.table, self.keys, self.to, self.start = None, np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int32), start.astype(np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray, count: np.ndarray) -> None:
        """Move every state by its letter, and count where that begins a phrase. A state of the table is a row's place in it."""
        if self.keys is None:
            v = self.table.take(state + codes)
            count += v & 1
            np.right_shift(v, 1, out=state)
            return
        key = state.astype(np.int64) * self.n + codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        count += ~known
        state[:] = np.where(known, self.to[at], self.start[codes])


def phrases(parts: list[np.ndarray], parsers: list[Parser]) -> np.ndarray:
    """Phrases of each non-empty part (rows) against each language (columns)."""
    order = np.argsort([-len(p) for p in parts], kind="stable")
    sizes = np.array([len(parts[i]) for i in order])
    grid = np.zeros((sizes[0], len(parts)), np.int32)
    for k, i in enumerate(order):
        grid[: sizes[k], k] = parts[i]
    state, count = (np.zeros((len(parsers), len(parts)), np.int32) for _ in range(2))
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for t in range(sizes[0]):
        k = active[t]
        for row, parser in enumerate(parsers):
            parser.step(state[row, :k], grid[t, :k], count[row, :k])
    out = np.empty((len(parts), len(parsers)), np.int32)
    out[order] = count.T
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes, parsers, bits = model.value
        for batch in batches:
            n = batch.num_rows
            parts, owner, has, length = [], [], np.zeros(n, bool), np.zeros(n)
            for i, value in enumerate(batch.column(1)):
                x = encode(value.as_py() or "", codes)
                has[i], length[i] = bool(x.any()), max(1, len(x))
                for at in range(0, len(x) if has[i] else 0, SEGMENT):
                    parts.append(x[at : at + SEGMENT])
                    owner.append(i)
            cost = np.zeros((n, len(langs)))
            if parts and langs:
                np.add.at(cost, np.array(owner), phrases(parts, parsers))
            cost *= bits / length[:, None]
            if langs:
                best = cost.argmin(axis=1)
                least = cost[np.arange(n), best]
                rest = cost.copy()
                rest[np.arange(n), best] = np.inf
                second = rest.min(axis=1) if len(langs) > 1 else np.full(n, np.inf)
                score = np.where(has, 1 - least / np.maximum(second, 1e-12), 0.0)
                names = [langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
            else:
                score, names = np.zeros(n), [UNDETERMINED] * n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["key", "lang_pred", "score"])

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, docs_a_language: int = SAMPLE_DOCS, doc_chars: int = SAMPLE_DOC_CHARS, chars: int = SAMPLE_CHARS):
    """Language names, letter codes, parsers, and bits a phrase; from a bounded sample by hashed id.

    A language's sample is at most ``docs_a_language`` documents, of each at most ``doc_chars`` characters from a place that its hash chooses, and of these an equal share of ``chars``.
    """
    text = F.col(text_col)
    spread = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - doc_chars + 1)).cast("int")
    rows = docs.where(F.col(lang_col).isNotNull() & text.rlike("[^\\x00-@\\[-`{-\\x7f]")).select(F.col(lang_col).alias("lang"), F.substring(text, spread + 1, F.lit(doc_chars)).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample: dict[str, dict[str, None]] = {}
    for r in rows.withColumn("turn", turn).where(F.col("turn") <= docs_a_language).orderBy("lang", "turn").collect():
        sample.setdefault(r.lang, {})[r.text] = None
    joined = {k: "\n".join(t[: max(1, chars // len(v))] for t in v) for k, v in sorted(sample.items())}
    codes, n = letter_codes(list(joined.values()))
    sequences = [encode(t, codes) for t in joined.values()]
    return list(joined), codes, [Parser(automaton(x), n) for x in sequences], np.array([log2(len(x) + 2) for x in sequences])


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score (0 to 1; 1 - least cost / next cost).

    ``labelled`` gives text and language to learn from; rows with a null language or no letter are not used. A text that is null or without a letter gets ``und`` and score 0, as
    do all texts if nothing was learned. Equal costs go to the first language by name. Only the text is used in a prediction. Repeated rows are predicted alike, null ids stay null, other columns
    are ignored, an empty table gives an empty result. Whole texts are parsed, very long ones in segments. ``bounds`` are those of ``learn``.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(labelled, text_col, lang_col, id_col, **bounds))
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = keyed.mapInArrow(_predict(model), f"key {keyed.schema['key'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("key", id_col)


def evaluated(docs: DataFrame) -> DataFrame:
    """The contract's rows: learned off the evaluation fold, predicted everywhere."""
    out = identify(docs, docs.where(~is_held_out(F.col("doc_id"))))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
