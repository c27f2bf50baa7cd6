"""Near-duplicate groups by one-permutation MinHash with optimal densification.

Method. A document's set is its distinct five-word shingles. Each shingle gets one 64-bit hash; its top bits
choose a bin, and a bin keeps its smallest hash (one permutation). An empty bin copies the first non-empty bin in
its own fixed random order, independent between bins (optimal densification), so that two documents agree in a bin
with a chance equal to their Jaccard similarity even when bins outnumber shingles. Bins are joined in bands; equal bands share
a bucket.

Candidate edges are stars. Documents are ranked by how many others they meet in all their buckets, so the member that most resembles
its group ranks first, and a bucket's centre is its first member. Buckets of one group mostly choose the same centre in every band: a bucket becomes
edges (centre, member), which are distinct over all bands, at most one for each member and bucket. Of a member's edges the one whose sketches agree best
is confirmed on full shingle sets.

A group, which is a centre with all members of its buckets, may hold several components after that. Then each member outside the group's largest component
is compared with all members of other components, in cells of two blocks of members: first sketches, then full sets of those members that
any sketch leaves. No pair becomes a row; a cell gives the links that join its components. As every two members of a bucket are in its centre's group, no
link between two members of a bucket depends on the choice of centres, and no round or partner is capped.

With 32 bands of 4 bins, a pair of similarity 0.75 shares no bucket with probability 5e-6. A pair is dropped
by its sketches if they agree in a share of bins that is lower than the wanted similarity by 0.2 or more; that is five
standard deviations, so a pair of similarity 0.75 is dropped with probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hinted, mix64, prepare, settle, shingle_hashes
from .components import connected_components

BANDS, ROWS = 32, 4
#: Up to so many ids of candidates (16 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of a star that one task confirms against its centre.
STAR = 2048
#: Members in a block whose sketches are compared, and in one whose sets are; a block of sets holds at most SET_BLOCK_HASHES shingles.
BLOCK, SET_BLOCK, SET_BLOCK_HASHES = 8192, 2048, 1 << 21
#: What names a cell: its group, its class of set sizes, and two blocks.
CELL = ["c", "k", "x", "y"]
_KIND = 1 << 20


def probe_orders(bins: int, seed: int = 7) -> np.ndarray:
    """Row i: the order in which empty bin i looks for a non-empty one; drawn independently for every bin."""
    return np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1)


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One hash for each bin from a sorted, non-empty array of distinct hashes."""
    bins = len(orders)
    shift = np.uint64(64 - bins.bit_length() + 1)
    at = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) << shift)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (least >> shift == np.arange(bins, dtype=np.uint64))
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = orders[empty]
        least[empty] = least[tried[np.arange(len(empty)), full[tried].argmax(axis=1)]]
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket key for each document and band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def _sketch(bands: int, rows: int, width: int):
    orders = probe_orders(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            sizes, keys, signatures, where = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = shingle_hashes(text.as_py(), hashes, width)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                if len(own):
                    signatures.append(signature(own, orders))
                    where.append(i)
            buckets, sketches = [None] * len(sizes), [None] * len(sizes)
            if where:
                stacked = np.array(signatures)
                for i, x, low in zip(where, band_keys(stacked, bands, rows), stacked.astype(np.uint8), strict=True):
                    buckets[i], sketches[i] = x, low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["id", "rank", "n", "set_key", "buckets", "sketch"],
            )

    return run


def _matrix(sketches: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(rows, -1)


def _likely(least: int):
    """Keep the pairs whose sketches, the low bytes of their signatures, agree in at least ``least`` places, and tell in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_matrix(batch.column(2), batch.num_rows) == _matrix(batch.column(3), batch.num_rows)).sum(axis=1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree, pa.int64())], ["u", "v", "agree"])
                yield out.filter(pa.array(agree >= least))

    return run


def _confirm_star(width: int, percent: int):
    """Links of members to their centre, whose text comes first among the rows of its star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, centre = None, None
        for batch in batches:
            found = []
            for v, u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingle_hashes(text.as_py(), hashes, width)
                if u == v:
                    last, centre = v, own
                elif v == last:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(centre) - both):
                        found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each cell from batches sorted by it."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(len(CELL))])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            cell = tuple(keys[:, at].tolist())
            if held and cell != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = cell
    if held:
        yield last, pa.Table.from_batches(held)


def _likely_in_cells(least: int, percent: int):
    """The members of a cell that may have a link to a member of another component: sizes and sketches allow it, and the star has not tested it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, _, x, y), rows in _by_cell(batches):
            block, node, n, component, tested = (rows.column(k).to_numpy() for k in ("block", "node", "n", "component", "tested"))
            sketch = _matrix(rows.column("sketch"), len(node))
            here, hit = np.arange(len(node)), np.zeros(len(node), bool)
            right = here[block == y]
            for i in here[block == x]:
                j = right[right > i] if x == y else right
                j = j[(component[j] != component[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
                if node[i] == c:
                    j = j[~tested[j]]
                elif tested[i]:
                    j = j[node[j] != c]
                j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
                if len(j):
                    hit[i] = hit[j] = True
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (np.full(len(at), c), node[at], n[at], component[at])], ["c", "node", "n", "component"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``left`` the sizes of its intersections with all of ``right``; frequent hashes by a matrix product, others by an inverted index."""
    flat = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    known, starts, counts = np.unique(flat, return_index=True, return_counts=True)
    often = np.flatnonzero(counts >= max(8, len(right) // 8))
    place = np.full(len(known), -1)
    place[often] = np.arange(len(often))
    dense = np.zeros((len(right), len(often)), np.float32)
    which = np.repeat(place, counts)
    dense[owner[which >= 0], which[which >= 0]] = 1
    chunk = max(1, min(64, (1 << 22) // max(1, len(often))))
    for begin in range(0, len(left), chunk):
        some = left[begin : begin + chunk]
        mine, rare = np.zeros((len(some), len(often)), np.float32), []
        for row, i in enumerate(some):
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            at = at[known[at] == sets[i]]
            mine[row, place[at[place[at] >= 0]]] = 1
            rare.append(at[place[at] < 0])
        common = (mine @ dense.T).astype(np.int64)
        for row, (i, at) in enumerate(zip(some, rare, strict=True)):
            many = counts[at]
            spots = np.repeat(starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield i, common[row] + np.bincount(owner[spots], minlength=len(right))


def _confirm_in_cells(width: int, percent: int):
    """Links that join the components of a cell, on full sets; pairs whose components earlier links of the cell have joined need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for (_, _, x, y), rows in _by_cell(batches):
            block, node, component = (rows.column(k).to_numpy() for k in ("block", "node", "component"))
            sets = [shingle_hashes(t.as_py(), hashes, width) for t in rows.column("text")]
            n, here, found = np.array(list(map(len, sets))), np.arange(len(node)), []
            left, right = here[block == x], here[block == y]
            root = np.unique(component, return_inverse=True)[1]
            if len(left) and len(right):
                for i, both in _overlaps(sets, left, right):
                    links = right[100 * both >= percent * (n[right] + n[i] - both)]
                    for j in links[root[links] != root[i]]:
                        if root[i] != root[j]:
                            found.append((node[i], node[j]))
                            root[root == root[j]] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _dealt(df: DataFrame, rows: int, keys: list[str], order: list) -> DataFrame:
    """Rows of equal keys together and sorted, in as many tasks as the session shuffles to: few rows can be much work here."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(parts, rows // 16 + 1)), *keys).sortWithinPartitions(*order)


def _cells(rows: DataFrame, block: Column) -> DataFrame:
    """The rows of each cell, from rows of groups (c, k) with ``upper`` and ``main``: members go in blocks of ``block`` members, and two blocks make a cell.

    Members with ``upper`` meet only those without; members with ``main``, of the group's largest component, only those of the rest.
    """
    kinds = range(4)
    rows = rows.withColumn("kind", F.col("upper").cast("int") + 2 * F.col("main").cast("int"))
    counts, n = settle(rows.groupBy("c", "k").agg(*[F.ceil(F.sum((F.col("kind") == t).cast("int")) / block).alias(f"b{t}") for t in kinds]).where("b0 > 0 or (b1 > 0 and b2 > 0)"))
    seq = [f"IF(b{t} > 0, sequence({t * _KIND}L, {t * _KIND}L + b{t} - 1), cast(array() as array<bigint>))" for t in kinds]
    own = F.expr(f"CASE kind {' '.join(f'WHEN {t} THEN {t * _KIND}L + pmod(xxhash64(node), b{t})' for t in kinds)} END")
    partners = F.expr(f"CASE kind WHEN 0 THEN concat({', '.join(seq)}) WHEN 1 THEN concat({seq[0]}, {seq[2]}) WHEN 2 THEN concat({seq[0]}, {seq[1]}) ELSE {seq[0]} END")
    placed = rows.join(hinted(counts, n), ["c", "k"]).withColumn("block", own).withColumn("other", F.explode(partners))
    return placed.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "kind", *[f"b{t}" for t in kinds])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest id reachable;
    kept is id = component_id. Texts that are null, empty or without a word have no shingles and are linked with
    nothing. Very long texts are compared whole. Rows that repeat an id with equal texts are one document; with differing texts each row takes the component of its text, and where that id is
    the smallest of several classes of equal texts, they are one node, compared by the text with the smallest hash. A row with a null id
    takes the component of equal texts, else null, and is kept only in the latter case. Equal similarities need no rule, as links have no order. Other columns are ignored, whatever
    their names. An empty table gives an empty result.

    Equal sets are collapsed by a 128-bit key before banding, so groups of copies cost one member. A group of m members, r of them outside its
    largest component after the stars, costs r * m comparisons of sketches, and of sets where these agree, but no more rows than
    m * (1 + r / BLOCK) of each.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rank"))
    schema = "id long, rank long, n long, set_key binary, buckets array<long>, sketch binary"
    sketched = texts_in.mapInArrow(_sketch(bands, rows, width), schema).checkpoint()
    labels, n_labels = _labels(sketched, texts_in, percent, width, int((percent / 100 - 0.2) * bands * rows))
    nodes = sketched.where("n > 0").groupBy("set_key").agg(F.min("id").alias("node"))
    if labels is not None:
        nodes = nodes.join(hinted(labels, n_labels), "node", "left").withColumn("node", F.coalesce("component", "node"))
    out = sketched.select("id", "n", "set_key").join(nodes.select("set_key", F.col("node").alias("component_id")), "set_key", "left")
    component = F.coalesce("component_id", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _labels(sketched: DataFrame, texts_in: DataFrame, percent: int, width: int, least: int) -> tuple[DataFrame | None, int]:
    """Node and component of all documents with a link, and their number."""
    usable = sketched.where("n > 0 and id is not null")
    members = usable.groupBy("set_key").agg(F.min("id").alias("node"), F.first("buckets").alias("buckets")).select("node", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    sizes, n_sizes = settle(sizes.select("bucket", "size"))
    if not n_sizes:
        return None, 0
    members, _ = settle(members.join(hinted(sizes, n_sizes), "bucket"))
    weights, n_near = settle(members.groupBy("node").agg(F.sum("size").alias("weight")))
    ranked = members.join(hinted(weights, n_near), "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node")).alias("c")).select("bucket", F.col("c.node").alias("c"))
    groups, n_groups = settle(members.join(hinted(centres, n_sizes), "bucket").select("c", "node").distinct())
    near = usable.join(hinted(weights.select(F.col("node").alias("id")), n_near, BROADCAST_IDS), "id", "left_semi")
    near, _ = settle(near.groupBy(F.col("id").alias("node")).agg(F.min(F.struct("rank", "n", "sketch")).alias("r")).select("node", "r.*"))

    pairs = (
        groups.where("node <> c")
        .join(near.select("node", "n", "sketch"), "node")
        .join(near.select(F.col("node").alias("c"), F.col("n").alias("c_n"), F.col("sketch").alias("c_sketch")), "c")
        .where(100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n"))
        .select("node", "c", "sketch", "c_sketch")
    )
    likely = pairs.mapInArrow(_likely(least), "u long, v long, agree long")
    star, n_star = settle(likely.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("best")).select("u", F.col("best.v").alias("v")))
    labels, n_labels, links = None, 0, None
    if n_star:
        links, n_links = settle(_star_links(star, n_star, near, texts_in, width, percent))
        if n_links:
            labels, n_labels = connected_components(links)
    found, n_found = _rest(groups, n_groups, near, star, n_star, labels, n_labels, texts_in, width, percent, least)
    if n_found:
        labels, n_labels = connected_components(found if links is None else links.unionByName(found))
    return labels, n_labels


def _with_texts(cells: DataFrame, n_cells: int, near: DataFrame, texts_in: DataFrame) -> DataFrame:
    """Rows with ``node`` and the text that stands for it."""
    needed, n = settle(near.select("node", "rank").join(hinted(cells.select("node").distinct(), n_cells), "node", "left_semi"))
    texts = texts_in.join(hinted(needed.withColumnRenamed("node", "id"), n, BROADCAST_IDS), ["id", "rank"]).select(F.col("id").alias("node"), "text")
    return texts.join(hinted(cells, n_cells), "node")


def _star_links(star: DataFrame, n_star: int, near: DataFrame, texts_in: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (member u, centre v) whose full sets are similar enough. A text is moved once as a member, and once as a centre for each STAR members."""
    large = star.groupBy("v").count().where(F.col("count") > STAR).select("v", F.ceil(F.col("count") / STAR).alias("parts"))
    large, n_large = settle(large)
    dealt = star.join(hinted(large, n_large), "v", "left").select("v", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0)).alias("part"), F.col("u").alias("node"))
    rows, n_rows = settle(dealt.unionByName(dealt.select("v", "part", F.col("v").alias("node")).distinct()))
    ordered = _dealt(_with_texts(rows, n_rows, near, texts_in).select("v", "node", "text", "part"), n_rows, ["v", "part"], ["v", "part", F.col("node") != F.col("v")])
    return ordered.mapInArrow(_confirm_star(width, percent), "u long, v long").distinct()


def _rest(
    groups: DataFrame, n_groups: int, near: DataFrame, star: DataFrame, n_star: int, labels: DataFrame | None, n_labels: int, texts_in: DataFrame, width: int, percent: int, least: int
) -> tuple[DataFrame | None, int]:
    """Links (u, v) that join different components inside groups, and their number."""
    here = groups.withColumn("component", F.col("node"))
    if labels is not None:
        here = groups.join(hinted(labels, n_labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = here.groupBy("c", "component").agg(F.count("*").alias("k")).groupBy("c").agg(F.count("*").alias("components"), F.max(F.struct("k", "component")).alias("most"))
    mixed, n_mixed = settle(mixed.where("components > 1").select("c", F.col("most.component").alias("largest")))
    if not n_mixed:
        return None, 0
    rest = (
        here.join(hinted(mixed, n_mixed), "c")
        .join(hinted(star.select(F.col("u").alias("node"), F.col("v").alias("c"), F.lit(True).alias("tested")), n_star), ["c", "node"], "left")
        .select("c", F.lit(0).cast("long").alias("k"), F.lit(False).alias("upper"), (F.col("component") == F.col("largest")).alias("main"), "node", "component", "largest", F.coalesce("tested", F.lit(False)).alias("tested"))
    )
    rest, n_rest = settle(rest)
    cells = _cells(rest.drop("largest").join(near.select("node", "n", "sketch"), "node"), F.lit(BLOCK)).select(*CELL, "block", "node", "n", "component", "tested", "sketch")
    maybe = _dealt(cells, n_rest, CELL, CELL).mapInArrow(_likely_in_cells(least, percent), "c long, node long, n long, component long").distinct()
    maybe, n_maybe = settle(maybe.join(hinted(mixed, n_mixed), "c"))
    if not n_maybe:
        return None, 0
    # Sets of linked members differ in size by less than one class, so members of class k meet those of k and k + 1.
    step = log(100 / percent) if 0 < percent < 100 else 1e-9 if percent >= 100 else 50.0
    k = F.floor(F.log("n") / step + 1e-9)
    main = F.col("component") == F.col("largest")
    both = maybe.select("c", k.alias("k"), F.lit(False).alias("upper"), main.alias("main"), "node", "component")
    both = both.unionByName(both.withColumn("k", F.col("k") - 1).withColumn("upper", F.lit(True)))
    block = F.greatest(F.lit(32), F.least(F.lit(SET_BLOCK), F.floor(SET_BLOCK_HASHES / F.exp(step * (F.col("k") + 2)))))
    cells, n_cells = settle(_cells(both, block).select(*CELL, "block", "node", "component"))
    ordered = _dealt(_with_texts(cells, n_cells, near, texts_in).select(*CELL, "block", "node", "component", "text"), n_cells, CELL, CELL)
    return settle(ordered.mapInArrow(_confirm_in_cells(width, percent), "u long, v long").distinct())


def oracle(percent: int = 75, width: int = 5) -> str:
    """The same rows in DuckDB SQL: all pairs that share a shingle, and all documents reachable over links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') words from documents where text is not null),
p as (select doc_id, words, unnest(range(0, greatest(1, len(words) - {width - 1}))) i from w where len(words) > 0),
s as (select distinct doc_id, array_to_string(words[i + 1:i + {width}], ' ') x from p),
n as (select doc_id, count(*) n from s group by doc_id),
b as (select a.doc_id u, b.doc_id v, count(*) both_n from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
e as (select u, v from b join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * both_n >= {percent} * (nu.n + nv.n - both_n)),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.v from r join e on e.u = r.other),
c as (select doc_id, min(other) component_id from r group by doc_id)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from c left join n using (doc_id)
"""
