"""What the training-data operators share: the shared folder, Arrow batches, words and 64-bit shingle hashes."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() usable and keep Arrow batches small enough for very long texts.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset a local session (as in tests) gets a temporary folder, and any other master
    an error, as executors would not see the driver's folder. Two Arrow settings are lowered for the session: the plans that need them run later.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        value = spark.conf.get(key, None)
        if value is None or not value.isdigit() or not 0 < int(value) <= most:
            spark.conf.set(key, str(most))


#: Tables of up to so many rows of a few longs are broadcast; their rows are counted first.
BROADCAST_ROWS = 200_000
_ROWS_A_TASK = 100_000


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """Cut lineage in the shared folder; the table, in no more partitions than its rows fill, and its rows."""
    df = df.checkpoint()
    n = df.count()
    parts = max(1, -(-n // _ROWS_A_TASK))
    return (df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df), n


def hinted(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``; a projected column could be inlined into a lambda and evaluated for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id):
    """The evaluation fold of the contracts: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an array, which is sorted in place; several times as fast as hashing them."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class WordHashes(dict):
    """Word bytes to 64-bit hashes; forgets everything at ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    A text of fewer words is one shingle; no text or no word gives an empty array.
    """
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + h[i : n - size + 1 + i]
    return distinct(mix64(out))
