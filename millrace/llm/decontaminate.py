"""Benchmark decontamination, in DataFrame operations only.

Method. A benchmark item of w words is compared with w-word windows of documents. Each window and item gets a SimHash of BITS bits of its words. A fingerprint is cut in BLOCKS
blocks of eight bits, and windows meet items of their size by an equi-join on (size, block, bits): all fingerprints within BLOCKS - 1 bits share a block, as so many
differences cannot touch every block. Pairs that meet within RADIUS bits are candidates. In each candidate's piece of text every window is then compared by exact
weighted similarity: the sum over five-word shingles of the smaller multiplicity, over the sum of the larger one.

The second occurrence of a word and later ones count as words of their own, so that no word outweighs the others. At a similarity of 0.75 the cosine is then about 0.857 or more, and a bit differs with
a probability of about 0.172 or less. Such a window shares no block with its item with
a probability of (1 - 0.828 ** 8) ** 32 = 0.0003, and is beyond RADIUS with one below 1e-5; unlike windows of equal size meet in an eighth of all cases and are almost never within RADIUS. A 64-bit
fingerprint would need a radius of 23 and blocks of two or three bits, which select nothing.

A window that shares no five-word shingle with any item has similarity 0 with all of them, so windows are fingerprinted only where a document's shingle equals one of an item
of that size: in every alignment that this gives, and where the window starts or ends with the first or last shingle of a run that agrees. Where shingles repeat, or items of one size share
a run, the best window can lie elsewhere.

So fingerprints can miss a pair, by chance or by the choice of windows. What they leave is found exactly: a window at the threshold holds at least ``percent`` percent of the item's n shingles, thus one of its
n - ceil(percent * n / 100) + 1 rarest (repeats counted), whatever these are. Pieces that hold such a shingle are candidates too. Items under five words have no shingle and are found as whole phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, let, prepare, settle

WIDTH, STEP = 5, 1024
#: Fingerprints: bits, their blocks, and the most bits in which a candidate may differ.
BITS, BLOCKS, RADIUS = 256, 32, 72
#: Item shingle keys are broadcast up to this many rows (16 bytes each), else joined by a shuffle.
BROADCAST_SHINGLES = 200_000
#: The alignment, each run's first shingle, and each run's last shingle as a window's end.
_STARTS = f"""array_distinct(concat(array(begin), filter(ps, (p, i) -> i = 0 OR get(ps, i - 1) < p - 1), transform(filter(ps, (p, i) -> i = size(ps) - 1 OR get(ps, i + 1) > p + 1), p -> p - size + {WIDTH})))"""
_SHINGLES = r"(?<![^ ])(?=([^ ]++(?: [^ ]++){%d}))[^ ]++"


def normalised(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def shingles(words: Column, width: int = WIDTH) -> Column:
    """All ``width``-word shingles of a space-separated text, in order, repeats included."""
    return F.regexp_extract_all(words, F.lit(_SHINGLES % (width - 1)), F.lit(1))


def simhash(words: str) -> Column:
    """SimHash of the words in a space-separated column as BITS / 64 longs: a bit is set if it is set in over half of the word hashes.

    A hash's bits are counted in lanes of a long, eight of eight bits up to 127 words and two of 32 bits beyond, so that one addition counts several bits.
    """
    def fingerprint(hashes: str, lane: int) -> str:
        mask = sum(1 << k for k in range(0, 64, lane))
        sums = f"transform(sequence(0, {lane - 1}), p -> aggregate(h, 0L, (s, x) -> s + (shiftrightunsigned(x, p) & {mask}L)))"
        bit = f"cast(2 * (shiftrightunsigned(get(c, b % {lane}), b - b % {lane}) & {(1 << lane) - 1}L) > size(h) as bigint)"
        return let("h", hashes, let("c", sums, f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft({bit}, b))"))

    def whole(lane: int) -> str:
        return "array(" + ", ".join(fingerprint(f"transform(w, x -> xxhash64(x, {k}))", lane) for k in range(BITS // 64)) + ")"

    return F.expr(let("w", f"split({words}, ' ')", f"IF(size(w) < 128, {whole(8)}, {whole(32)})"))


def numbered(words: str) -> str:
    """SQL for the words of a space-separated column in any order, a word's repeats told apart by their number."""
    return let("s", f"array_sort(split({words}, ' '))", "array_join(transform(s, (x, i) -> IF(array_position(s, x) = i + 1, x, concat(x, '#', i + 1 - array_position(s, x)))), ' ')")


def blocks(fingerprint: str) -> Column:
    """The fingerprint's blocks as (block, bits)."""
    width = BITS // BLOCKS
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> named_struct('block', i, 'bits', shiftrightunsigned(get({fingerprint}, i div {64 // width}), {width} * (i % {64 // width})) & {(1 << width) - 1}L))")


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.expr(" + ".join(f"bit_count(get({a}, {k}) ^ get({b}, {k}))" for k in range(BITS // 64)))


def _pieces(texts: DataFrame, longest: int) -> DataFrame:
    """Normalised texts in pieces: at (id, tag, turn), and the STEP + longest words from word turn * STEP on."""
    return (
        texts.select("who", F.split(normalised(F.col("text")), " ").alias("words"))
        .select("who", "words", F.explode_outer(F.expr(f"sequence(0, cast((size(words) - 1) div {STEP} as int))")).alias("turn"))
        .select(F.struct("who.id", "who.tag", "turn").alias("at"), F.array_join(F.slice("words", F.col("turn") * STEP + 1, F.lit(STEP + longest)), " ").alias("piece"))
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """One row per document and item that it holds: id_col, item_col, similarity (six digits), start (word, from 0).

    Of a document's windows the most similar one counts, the earliest on ties. Windows are clipped at the ends of a document. Texts are compared as
    lower-cased runs of letters and digits. Null, empty and wordless texts hold nothing, and null and wordless items are found nowhere; an item under five words is
    found, with similarity 1, where its words stand in a row. Rows that repeat a document or item id give one row; null ids group together. Other columns are
    ignored, whatever their names. Empty tables give an empty result.

    Documents are read in pieces of STEP words that overlap by the longest item, so a very long text bounds no task; those that hold a shingle of an item are kept in the shared folder.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = (
        items.select(F.col(item_col).alias("item"), normalised(F.col(item_text_col)).alias("body"))
        .where("body <> ''")
        .distinct()
        .withColumn("own", shingles(F.col("body")))
        .withColumn("size", F.size(F.split("body", " ")))
        .withColumn("print", simhash(numbered("body")))
        .withColumn("b", F.xxhash64("body"))
        .checkpoint()
    )
    phrases = bench.where(F.size("own") == 0).select("item", "body", "size")
    short = [(r["size"], r["count"]) for r in phrases.groupBy("size").count().orderBy("size").collect()]
    bench = bench.where(F.size("own") > 0)
    longest, n = bench.agg(F.coalesce(F.max("size"), F.lit(WIDTH)), F.coalesce(F.sum(F.size("own")), F.lit(0))).first()
    bodies = bench.dropDuplicates(["b"])
    keys = bodies.select("size", F.posexplode("own").alias("at", "shingle")).select(F.xxhash64("shingle").alias("key"), "size", "at").distinct()
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag")).alias("who"), F.col(text_col).alias("text"))
    # Outer explodes: the filters that Spark infers for inner ones would run the patterns again.
    pieces = texts.transform(_pieces, longest)
    begin = F.col("pos") - F.col("at")
    anchors = (
        pieces.select(F.col("at").alias("piece_at"), F.posexplode_outer(shingles(F.col("piece"))).alias("pos", "shingle"))
        .select("piece_at", "pos", F.xxhash64("shingle").alias("key"))
        .where("pos is not null")
        .join(hinted(keys, n, BROADCAST_SHINGLES), "key")
        .groupBy("piece_at", "size", begin.alias("begin"))
        .agg(F.array_sort(F.collect_set("pos")).alias("ps"))
        .select(F.col("piece_at").alias("at"), "size", F.explode(F.expr(let("ps", "ps", _STARTS))).alias("begin"))
        .where((F.col("begin") < STEP) & ((F.col("begin") >= 0) | (F.col("at.turn") == 0)))
        .distinct()
    )
    anchors, n_anchors = settle(anchors)
    holders, n_holders = settle(anchors.select(F.struct("at.id", "at.tag").alias("who")).distinct())
    found = texts.join(hinted(holders, n_holders), "who", "left_semi").checkpoint().transform(_pieces, longest)
    windows = (
        found.select("at", F.split("piece", " ").alias("words"))
        .join(hinted(anchors, n_anchors), "at")
        .select("at", "size", F.array_join(F.slice("words", F.greatest("begin", F.lit(0)) + 1, F.greatest(F.lit(0), F.col("size") + F.least("begin", F.lit(0)))), " ").alias("window"))
        .distinct()
        .select("at", "size", simhash(numbered("window")).alias("print"))
    )
    index = bodies.select("b", "size", F.col("print").alias("item_print"), F.explode(blocks("print")).alias("k")).select("b", "size", "item_print", "k.*")
    candidates = (
        windows.select("*", F.explode(blocks("print")).alias("k"))
        .select("*", "k.*")
        .join(index, ["size", "block", "bits"])
        .where(distance("print", "item_print") <= radius)
        .select("at", "b")
    )
    own = bodies.select("b", F.size("own").alias("n"), F.explode("own").alias("shingle")).groupBy("b", "n", F.xxhash64("shingle").alias("key")).agg(F.count("*").cast("int").alias("m")).checkpoint()
    spots = (
        found.select("at", (F.size(F.split("piece", " ")) - WIDTH + 1).alias("have"), F.posexplode_outer(shingles(F.col("piece"))).alias("pos", "shingle"))
        .select("at", "have", "pos", F.xxhash64("shingle").alias("key"))
        .where("pos is not null")
    )
    rest = spots.join(hinted(own.transform(_rarest, percent), n, BROADCAST_SHINGLES), "key").select("at", "b")
    pairs, _ = settle(candidates.unionByName(rest).distinct())
    wanted = pairs.join(hinted(own, n, BROADCAST_SHINGLES), "b")
    spots = spots.join(hinted(own.select("key").distinct(), n, BROADCAST_SHINGLES), "key", "left_semi")
    best = spots.join(wanted, ["at", "key"]).transform(_best_windows, percent)
    best = best.join(hinted(bench.select("b", "item"), n, BROADCAST_SHINGLES), "b").groupBy("id", "item").agg(F.max("best").alias("best"))
    best = best.select("id", "item", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.start")).alias("start"))
    for size, count in short:
        best = best.unionByName(_phrases(pieces, phrases.where(F.col("size") == size), size, count))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start")


def _rarest(own: DataFrame, percent: int) -> DataFrame:
    """Of each item's shingles those, held by the fewest items, of which every window at the threshold holds one: b, key."""
    before = F.sum("m").over(Window.partitionBy("b").orderBy("items", "key").rowsBetween(Window.unboundedPreceding, -1))
    held = own.join(own.groupBy("key").agg(F.count("*").alias("items")), "key")
    return held.withColumn("before", F.coalesce(before, F.lit(0))).where(f"before <= n - ceil({percent} * n / 100)").select("b", "key")


def _best_windows(hits: DataFrame, percent: int) -> DataFrame:
    """The best (similarity, -start) of each id and item text b, over all windows of the pieces; a hit is a shingle's place ``pos`` in a piece of ``have`` shingles, and its number ``m`` among the ``n`` of the item.

    Among windows of n shingles a place counts in those that hold it, but not the place m before it of the same shingle: an interval of starts. So the sum of smaller multiplicities is the
    number of intervals over a start, and the best starts are where an interval begins or, in windows clipped by the text's end, before one ends.
    """
    first = "greatest(p - n + 1, get(ps, i - m) + 1, IF(at.turn > 0, 0, NULL))"
    starts = Window.partitionBy("at", "b").orderBy("start")
    so_far = lambda last: F.coalesce(F.sum("change").over(starts.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    return (
        hits.groupBy("at", "b", "n", "have", "m", "key")
        .agg(F.array_sort(F.collect_set("pos")).alias("ps"))
        .select("at", "b", "n", "have", F.explode(F.expr(f"transform(ps, (p, i) -> named_struct('first', {first}, 'after', least(p + 1, {STEP})))")).alias("x"))
        .where("x.first < x.after")
        .select("at", "b", "n", "have", F.explode(F.expr("array(named_struct('start', x.first, 'change', 1), named_struct('start', x.after, 'change', -1))")).alias("x"))
        .select("at", "b", "n", "have", "x.*")
        .withColumns({"now": so_far(Window.currentRow), "before": so_far(-1)})
        .select("at", "b", "n", "have", F.explode(F.expr("array(named_struct('start', start, 'both', now), named_struct('start', start - 1, 'both', before))")).alias("x"))
        .select("at", "b", "x.start", "x.both", F.expr("n + least(x.start + n, have) - greatest(x.start, 0) - x.both").alias("all"))
        .where(F.expr(f"both > 0 and 100 * both >= {percent} * all"))
        .groupBy("at.id", "b")
        .agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("at.turn").cast("long") * STEP - F.greatest("start", F.lit(0))).alias("start"))).alias("best"))
    )


def _phrases(pieces: DataFrame, items: DataFrame, size: int, count: int) -> DataFrame:
    """The best rows of items of ``size`` words, fewer than a shingle has."""
    found = pieces.select("at", F.posexplode_outer(shingles(F.col("piece"), size)).alias("pos", "body")).where("pos is not null").join(hinted(items.select("item", "body"), count), "body")
    start = F.col("at.turn").cast("long") * STEP + F.col("pos")
    return found.groupBy("at.id", "item").agg(F.lit(1.0).alias("similarity"), F.min(start).alias("start"))


def oracle(percent: int = 75) -> str:
    """The same rows in DuckDB SQL: of every document and item with a common shingle, every window that can hold one, compared exactly."""
    body = r"string_split(trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')), ' ')"
    return rf"""
with d as (select doc_id, {body.format(t='text')} w from documents where text is not null),
b as (select item_id, {body.format(t='text')} w from benchmark where text is not null),
dr as (select doc_id, w, unnest(range(0, len(w) - 4)) p from d where len(w) >= 5),
br as (select item_id, w, unnest(range(0, len(w) - 4)) p from b where len(w) >= 5),
ds as (select doc_id, p, array_to_string(w[p + 1:p + 5], ' ') s from dr),
bs as (select item_id, p, len(w) n, array_to_string(w[p + 1:p + 5], ' ') s from br),
c as (select doc_id, item_id, n, min(ds.p) - n + 5 lo, max(ds.p) hi from ds join bs on ds.s = bs.s group by doc_id, item_id, n),
v as (select doc_id, item_id, n, unnest(range(lo, hi + 1)) st from c),
m as (select v.doc_id, item_id, st, n, s, count(*) c from v join ds on v.doc_id = ds.doc_id and ds.p between st and st + n - 5 group by all),
bc as (select item_id, s, count(*) c from bs group by all),
t as (select m.doc_id, m.item_id, st, n, sum(m.c) nw, sum(least(m.c, coalesce(bc.c, 0))) both_n from m left join bc on m.item_id = bc.item_id and m.s = bc.s group by all),
r as (select doc_id, item_id, both_n / (nw + n - 4 - both_n) sim, greatest(st, 0) st from t where 100 * both_n >= {percent} * (nw + n - 4 - both_n))
select doc_id, item_id, round(max(sim), 6) similarity, cast(arg_max(st, struct_pack(x := sim, y := -st)) as bigint) "start" from r group by doc_id, item_id
union all
select doc_id, item_id, 1.0::double, cast(min(p) as bigint) from (select doc_id, w, unnest(range(0, len(w))) p from d) x join b on len(b.w) < 5 and b.w[1] <> '' and x.w[p + 1:p + len(b.w)] = b.w group by doc_id, item_id
"""
