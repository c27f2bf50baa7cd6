"""Chunking: paragraphs and sentences packed into overlapping chunks, and the prose filters on chunks. Array expressions, but for ``build_chunks``; nothing is shuffled.

Token counts are those of ``functions.text.TOKEN``, an additive stand-in for a BPE, so a chunk's size is the sum of its units'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TERMINAL, TOKEN, WS, count_tokens, duck, duck_has, duck_tokens, duck_trimmed, duck_words, exploded, has, let, lit, n_words, trimmed
from ..session import shared_checkpoints

CHUNK_TOKENS, OVERLAP_TOKENS = 512, 64
SENTENCE = rf"""[^.!?]+[.!?]+[{WS}"')\]]*|[^.!?]+$"""
HEADING = f"^##[{WS}]+"
CAPITAL = f"(?:^|[{WS}])[A-Z]"
#: Fixed value: verbs that make a line a statement.
VERB = (
    r"(?i)\b(is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|will|would|should|may|might|must|says?|said|means?|meant|refers?|includes?|shows?|describes?|explains?|allows?|makes?|made|"
    r"gives?|gave|takes?|took|uses?|used|provides?|requires?|becomes?|became|remains?|consists?|contains?|occurs?|exists?)\b"
)


def window(ceiling: int) -> str:
    return rf"(?:[{WS}]*(?:{TOKEN})){{1,{ceiling}}}"


def units(text: str, chunk_tokens: int) -> str:
    """Array of (t, n): paragraphs, or for long ones their sentences, or for long ones token windows; at most half a chunk each. Tokens of a piece are counted once."""
    ceiling = max(1, chunk_tokens // 2)
    counted = lambda x: let("t", x, let("n", count_tokens("t"), "named_struct('t', t, 'n', n)"))
    sentences = f"filter(transform(regexp_extract_all(p.t, {lit(SENTENCE)}, 0), s -> {trimmed('s')}), s -> s <> '')"
    pieces = f"transform(filter(transform(regexp_extract_all(s.t, {lit(window(ceiling))}, 0), w -> {trimmed('w')}), w -> w <> ''), w -> {counted('w')})"
    each = let("q", f"transform({sentences}, s -> {counted('s')})", f"flatten(transform(IF(size(q) = 0, array(p), q), s -> IF(s.n > {ceiling}, {pieces}, array(s))))")
    paragraphs = f"transform(filter(transform(split({text}, '\\n{{2,}}'), p -> {trimmed('replace(p, chr(10), chr(32))')}), p -> p <> ''), p -> {counted('p')})"
    return f"flatten(transform({paragraphs}, p -> IF(p.n <= {ceiling}, array(p), {each})))"


def packed(units_col: str, chunk_tokens: int, overlap_tokens: int, drop_short_tail: bool = True) -> str:
    """Array of (text, tokens): a fold over units that closes a full chunk and carries its tail of at most ``overlap_tokens``, never all of it.

    The fold holds only where the open chunk starts and where chunks were cut; tokens are differences of running sums, and each chunk is sliced out once.
    """
    sums = f"aggregate({units_col}, array(0), (a, u) -> array_append(a, element_at(a, -1) + u.n))"
    # From the cut at i back to the start s: the first place from which no more than the overlap is left, but never s itself.
    carry = f"i - least(i - a.s - 1, size(filter(slice(sums, a.s + 1, i - a.s), x -> get(sums, i) - x <= {overlap_tokens})))"
    full = f"i > a.s AND get(sums, i + 1) - get(sums, a.s) > {chunk_tokens}"
    step = f"IF({full}, named_struct('s', {carry}, 'cuts', array_append(a.cuts, named_struct('a', a.s, 'b', i))), a)"
    last = f"size({units_col})"
    keep = f"{last} > a.s AND (size(a.cuts) = 0 OR get(sums, {last}) - get(sums, a.s) > {overlap_tokens if drop_short_tail else -1})"
    start = "named_struct('s', 0, 'cuts', cast(array() as array<struct<a: int, b: int>>))"
    fold = f"aggregate(sequence(0, size({units_col}) - 1), {start}, (a, i) -> {step}, a -> IF({keep}, array_append(a.cuts, named_struct('a', a.s, 'b', {last})), a.cuts))"
    body = f"named_struct('text', array_join(transform(slice({units_col}, c.a + 1, c.b - c.a), x -> x.t), '\n'), 'tokens', get(sums, c.b) - get(sums, c.a))"
    empty = "cast(array() as array<struct<text: string, tokens: int>>)"
    return f"IF(size({units_col}) > 0, {let('sums', sums, f'transform({fold}, c -> {body})')}, {empty})"


def with_chunks(pages: DataFrame, text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, drop_short_tail: bool = True) -> DataFrame:
    """Add ``chunks``, an array of (text, tokens). Null and blank texts have none. As long as overlap + half a chunk <= chunk, no chunk exceeds chunk_tokens."""
    if overlap_tokens >= chunk_tokens:
        raise ValueError("overlap_tokens must be smaller than chunk_tokens")
    return pages.withColumn("chunks", F.expr(let("us", units(f"coalesce({text_col}, '')", chunk_tokens), packed("us", chunk_tokens, overlap_tokens, drop_short_tail))))


def _prose(x: str) -> str:
    return f"({n_words(x)} >= 8 AND {has(x, TERMINAL)})"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {lit(HEADING)}, '')"


def is_listing(line: str) -> str:
    """Whether a trimmed line is a label or name list rather than a statement."""
    rule = (
        f"CASE WHEN b = '' THEN true WHEN {_prose('b')} THEN false WHEN NOT {has('b', VERB)} AND NOT {has('b', '[.!?]$')} THEN true"
        f" ELSE {n_words('b')} >= 3 AND regexp_count(b, {lit(CAPITAL)}) >= 0.6 * {n_words('b')} END"
    )
    return let("b", trimmed(_bare(line)), rule)


def has_prose(text: str) -> str:
    """Whether a text can answer something: short ones need one sentence, others prose lines with 34 % of the words and at most half listing lines."""
    lines = f"filter(transform(split({text}, '\\n'), l -> {trimmed(_bare('l'))}), l -> l <> '')"
    words = lambda x: f"aggregate({x}, 0, (s, l) -> s + {n_words('l')})"
    long = let("pl", f"filter(ls, l -> {_prose('l')})", f"size(pl) > 0 AND {words('pl')} >= 0.34 * total AND 2 * size(filter(ls, l -> {is_listing('l')})) <= size(ls)")
    return let("ls", lines, let("total", words("ls"), f"IF(total < 25, exists(ls, l -> {has('l', TERMINAL)}), {long})"))


def without_leading_labels(text: str) -> str:
    """The text from its first prose line on, or from a heading directly above one; unchanged without any."""
    stop = f"{_prose(_bare('l'))} OR (startswith(l, '## ') AND {_prose('coalesce(get(ls, i + 1), chr(32))')})"
    first = f"array_position(transform(ls, (l, i) -> {stop}), true)"
    whole = let("ls", f"transform(raw, l -> {trimmed('l')})", let("k", first, trimmed("array_join(IF(k = 0, raw, slice(raw, cast(k as int), size(raw))), '\\n')")))
    return let("raw", f"split({text}, '\\n')", whole)


def without_listing_lines(text: str) -> str:
    """Prose lines, headings directly above prose, and lines that are no listing."""
    stay = f"{_prose(_bare('l'))} OR (startswith(l, '## ') AND {_prose(_bare('coalesce(get(ls, i + 1), chr(32))'))}) OR NOT {is_listing('l')}"
    return let("ls", f"filter(transform(split({text}, '\\n'), l -> {trimmed('l')}), l -> l <> '')", trimmed(f"array_join(filter(ls, (l, i) -> {stay}), '\\n')"))


def refined(chunks_col: str = "chunks") -> str:
    """Array of (text, tokens): chunks that can answer something, without labels and listings, and not mere residue."""
    kept = f"filter({chunks_col}, c -> {has_prose('c.text')})"
    short = f"transform(transform({kept}, c -> {without_listing_lines(without_leading_labels('c.text'))}), t -> named_struct('text', t, 'tokens', {count_tokens('t')}))"
    return f"filter({short}, c -> c.text <> '' AND ({has('c.text', TERMINAL)} OR c.tokens >= 8))"


def build_chunks(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "cleaned", **sizes) -> DataFrame:
    """One row per chunk: id, chunk_index (contiguous from 0), text, token_count."""
    from .passages import built

    return built(cleaned, [id_col], text_col, clean_first=False, **sizes)


def capped(chunks: DataFrame, most: int, page_col: str = "doc_id", kb_col: str | None = None) -> DataFrame:
    """The first ``most`` chunks of each knowledge base in document order (0: all), pages renumbered densely from 0 as page_index.

    With a cut, chunks are ranked in one pass, so what makes them runs once; each task keeps the first ``most`` of a knowledge base before the shuffle. Without a cut
    page counts are sorted by range, numbered within their range and shifted by the counts of the ranges before.
    """
    from pyspark.sql import Window

    keys = [kb_col] if kb_col else []
    if most:
        first = chunks.orderBy(page_col, "chunk_index").limit(most)
        if keys:
            order = Window.partitionBy(*keys).orderBy(page_col, "chunk_index")
            first = chunks.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")
        return first.withColumn("page_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy(page_col)) - 1)
    counts = chunks.groupBy(*keys, page_col).agg(F.count("*").alias("n"))
    shared_checkpoints(chunks.sparkSession)
    ranged = counts.repartitionByRange(*keys, page_col).withColumn("range", F.spark_partition_id()).checkpoint()
    shifts = ranged.groupBy(*keys, "range").agg(F.count("*").alias("pages"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shifts.select(*keys, "range", F.coalesce(F.sum("pages").over(earlier), F.lit(0)).alias("shift"))
    within = Window.partitionBy(*keys, "range").orderBy(page_col)
    pages = ranged.withColumn("turn", F.row_number().over(within)).join(F.broadcast(shifts), [*keys, "range"]).select(*keys, page_col, (F.col("shift") + F.col("turn") - 1).alias("page_index"))
    return chunks.join(pages, [*keys, page_col])


# DuckDB counterparts.


def duck_units(text: str, chunk_tokens: int) -> str:
    ceiling = max(1, chunk_tokens // 2)
    sentences = f"list_filter(list_transform(regexp_extract_all(p, {duck(SENTENCE)}), lambda s: {duck_trimmed('s')}), lambda s: s <> '')"
    pieces = f"list_filter(list_transform(regexp_extract_all(s, {duck(window(ceiling))}), lambda w: {duck_trimmed('w')}), lambda w: w <> '')"
    each = f"flatten(list_transform(case when len({sentences}) = 0 then [p] else {sentences} end, lambda s: case when {duck_tokens('s')} > {ceiling} then {pieces} else [s] end))"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({text}, '\\n{{2,}}'), lambda p: {duck_trimmed('replace(p, chr(10), chr(32))')}), lambda p: p <> '')"
    return f"list_transform(flatten(list_transform({paragraphs}, lambda p: case when {duck_tokens('p')} <= {ceiling} then [p] else {each} end)), lambda u: {{'t': u, 'n': {duck_tokens('u')}}})"


def oracle_chunks(source: str, chunk_tokens: int, overlap_tokens: int) -> str:
    """DuckDB CTEs (after ``with recursive`` and ``source``, a relation of doc_id and text) that end in ``k``: doc_id, i (from 0), text, tokens."""
    total = "coalesce(list_sum(list_transform({0}, lambda x: x.n)), 0)"
    count = f"len(list_filter(range(1, len(cur) + 1), lambda j: {total.format('cur[j:]')} <= {overlap_tokens}))"
    return f"""us as (select doc_id, {duck_units('text', chunk_tokens)} u from {source}),
fold as (select doc_id, 1 i, u, u[1:1] cur, u[1:0] done, false closed, 0 k from us where len(u) > 0
  union all select doc_id, i + 1, u, case when full_now then list_concat(cur[len(cur) + 1 - least(c, len(cur) - 1):], u[i + 1:i + 1]) else list_concat(cur, u[i + 1:i + 1]) end, cur, full_now, k + full_now::int
  from (select *, {total.format('cur')} + u[i + 1].n > {chunk_tokens} full_now, {count} c from fold where i < len(u))),
k as (select doc_id, k - 1 i, list_transform(done, lambda x: x.t) ts, {total.format('done')} tokens from fold where closed
  union all select doc_id, k, list_transform(cur, lambda x: x.t), {total.format('cur')} from fold where i = len(u) and (k = 0 or {total.format('cur')} > {overlap_tokens})),
kk as (select doc_id, i, array_to_string(ts, chr(10)) text, tokens from k)
"""


def _dprose(x: str) -> str:
    return f"({duck_words(x)} >= 8 and {duck_has(x, TERMINAL)})"


def _dbare(x: str) -> str:
    return f"regexp_replace({x}, {duck(HEADING)}, '')"


def duck_listing(line: str) -> str:
    b = duck_trimmed(_dbare(line))
    return (
        f"(case when {b} = '' then true when {_dprose(b)} then false when not {duck_has(b, VERB)} and not {duck_has(b, '[.!?]$')} then true"
        f" else {duck_words(b)} >= 3 and len(regexp_extract_all({b}, {duck(CAPITAL)})) >= 0.6 * {duck_words(b)} end)"
    )


def duck_has_prose(text: str) -> str:
    ls = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {duck_trimmed(_dbare('l'))}), lambda l: l <> '')"
    words = lambda x: f"coalesce(list_sum(list_transform({x}, lambda l: {duck_words('l')})), 0)"
    pl = f"list_filter({ls}, lambda l: {_dprose('l')})"
    return (
        f"(case when {words(ls)} < 25 then len(list_filter({ls}, lambda l: {duck_has('l', TERMINAL)})) > 0"
        f" else len({pl}) > 0 and {words(pl)} >= 0.34 * {words(ls)} and 2 * len(list_filter({ls}, lambda l: {duck_listing('l')})) <= len({ls}) end)"
    )


def duck_without_labels(text: str) -> str:
    raw = f"string_split({text}, chr(10))"
    ls = f"list_transform({raw}, lambda l: {duck_trimmed('l')})"
    stop = f"{_dprose(_dbare('l'))} or (starts_with(l, '## ') and {_dprose(f'coalesce({ls}[i + 1], chr(32))')})"
    k = f"coalesce(list_position(list_transform({ls}, lambda l, i: {stop}), true), 0)"
    return duck_trimmed(f"array_to_string(case when {k} = 0 then {raw} else {raw}[{k}:] end, chr(10))")


def duck_without_listings(text: str) -> str:
    ls = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {duck_trimmed('l')}), lambda l: l <> '')"
    stay = f"{_dprose(_dbare('l'))} or (starts_with(l, '## ') and {_dprose(_dbare(f'coalesce({ls}[i + 1], chr(32))'))}) or not {duck_listing('l')}"
    return duck_trimmed(f"array_to_string(list_filter({ls}, lambda l, i: {stay}), chr(10))")
