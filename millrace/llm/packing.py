"""Best-fit packing of documents into token sequences, with certified bin counts.

Method. Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of bounded size; each packs its own
by best-fit decreasing and compares its bins with a lower bound from dual feasible functions. A
partition whose count meets the bound is certified; one with a gap hands all its pieces to the exchange. A certified
partition hands over its emptiest bin, since the bounds of many partitions each round up. Exchanged pieces are dealt anew to
larger partitions and packed again, as long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .tokens import default_vocabulary, encoder

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, lane long"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these integer lengths needs, by two families of dual feasible functions.

    First, for each threshold a <= capacity / 2: lengths over capacity - a count as a whole bin, lengths under a
    as nothing, others as themselves. Second, for k = 1..20, x is rounded to floor((k + 1) x / capacity) / k
    unless (k + 1) x / capacity is whole. An empty input needs no bin.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    a = np.arange(1, capacity // 2 + 1)
    high = capacity - a
    value = (number[-1] - number[high]) * capacity + total[high] - total[a - 1]
    best = max(int(total[-1]), int(value.max()))
    bound = -(-best // capacity)
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = (k + 1) * x
        rounded = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        bound = max(bound, -(-int((counts * rounded).sum()) // (k * capacity)))
    return bound


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin. Ties between bins or pieces go by position."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _cut(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = encoder(vocabulary), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                start, piece = 0, 0
                end = (len(ids) - 1) % capacity + 1
                while start < len(ids):
                    part = ids[start:end]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None, lane), strict=True):
                        column.append(value)
                    start, end, piece, lane = end, end + capacity, piece + 1, lane + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "lane"])

    return run


def _packer(capacity: int, turn: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        part = group.column("part")[0].as_py()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if last:
            release = np.zeros(len(bins), bool)
        elif len(fills) > bound:
            release = np.ones(len(bins), bool)
        else:
            emptiest = int(fills.argmin())
            release = (bins == emptiest) & (fills[emptiest] < capacity)
        out = group.drop_columns(["part"])
        for name, values in (("sequence_id", ((turn << 36) + part << 20) + bins), ("offset", offsets), ("released", release)):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def _pack(pieces: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    part = F.pmod(F.xxhash64("lane", "doc_id", "piece", F.lit(turn)), F.lit(parts))
    schema = _PIECES + ", sequence_id long, offset long, released boolean"
    names = [x.split()[0] for x in _PIECES.split(", ")]
    return pieces.select(*names, part.alias("part")).groupBy("part").applyInArrow(_packer(capacity, turn, parts == 1), schema).checkpoint()


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, part_pieces: int = 16_384, max_rounds: int = 5
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids when ``with_ids``).

    A document is its token ids and a closing 0; only one longer than ``capacity`` is cut, its first piece may be short.
    A null or empty text is the closing 0 alone, so every row gives a piece. Repeated rows are separate
    documents; other columns are ignored, whatever their names; an empty table gives no piece. Null ids stay null.

    Partitions hold about ``part_pieces`` pieces, four times as many in each round of exchange and 65,536 at most (16,384 when ``with_ids``, 8 KB each). Exchange ends when the pool
    meets its bound, when a round saves nothing, or after ``max_rounds``; nothing is lost by that but the last few sequences (none over the bound at 10,000 documents). Equal lengths are
    placed by their order in the partition, so ties change only which document lies where.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, with_ids), _PIECES).checkpoint()
    n = pieces.count()
    packed = _pack(pieces, max(1, -(-n // part_pieces)), capacity, 0)
    settled, pool = packed.where("not released"), packed.where("released")
    for turn in range(1, max_rounds + 1):
        n, bins, tokens = pool.agg(F.count("*"), F.count_if(F.col("offset") == 0), F.coalesce(F.sum("length"), F.lit(0))).first()
        if bins <= -(-tokens // capacity):
            break
        again = _pack(pool, max(1, -(-n // min(16_384 if with_ids else 65_536, part_pieces * 4**turn))), capacity, turn)
        if again.agg(F.count_if(F.col("offset") == 0)).first()[0] >= bins:
            break
        settled, pool = settled.unionByName(again.where("not released")), again.where("released")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return settled.unionByName(pool).select(*names)


def sequences(packed: DataFrame) -> DataFrame:
    """From pieces with ids: sequence_id, input_ids in order, and the offset at which each piece starts. A sequence is at most ``capacity`` long."""
    part = F.struct("offset", "ids")
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return ordered.select("sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.offset").alias("starts"))
