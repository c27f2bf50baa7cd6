"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Method. A word is the bag of its character n-grams (with word boundary marks), hashed into buckets of vectors; a window of words is the average of all their
vectors; a linear softmax over that average gives the window's logit. Vectors and weights are trained together, so an unseen misspelling
scores through the n-grams that it shares. Training
starts from all windows of toxic texts and then takes each one's highest windows. All windows of SCORE_WINDOW words of a text are scored by the softmax of their averaged bags,
and the text's logit is the mean of its TOP_WINDOWS highest, so that a few toxic words in a long text are not averaged away, and one chance resemblance does not decide. A
logistic curve on the text logits, fitted on texts that the vectors were not trained on, gives the score.

As the model is linear in the average, each n-gram's part of the logit is one number, and a window's logit is a difference of running sums over words.
Runs without a blank of over PIECE characters are read as words of PIECE characters that overlap by an n-gram, so every character counts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import calibrate
from .common import distinct, is_held_out, mix64, prepare

BUCKETS, DIMS, GRAMS = 1 << 16, 10, (3, 5)
WINDOW, STRIDE = 8, 4
#: A text is judged by so many of its windows of so many words, and an n-gram is known from so many training texts on.
TOP_WINDOWS, SCORE_WINDOW, LEAST_TEXTS = 5, 3, 4
#: Bounds of the training sample: texts of each label, characters of a text (longer texts are not in the sample), and windows of a text without toxicity, drawn at random.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WINDOWS = 2000, 6000, 8
#: Characters of a piece of a longer word.
PIECE = 64
THRESHOLD = 0.3
_PRIME = np.uint64(0x100000001B3)
_EDGE = b"""'<>*#%&|-_=+~`/\\"""
#: A-Z to a-z, and sentence marks and brackets to blanks.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\"()[]{}", b"abcdefghijklmnopqrstuvwxyz" + b" " * 13)


def words_of(text: str | None) -> list[bytes]:
    """Runs between blanks and sentence marks; a run of over PIECE characters in pieces that overlap by an n-gram less one character."""
    words = text.encode().translate(_FOLD).split() if text else []
    if max(map(len, words), default=0) <= PIECE:
        return words
    step, out = PIECE - GRAMS[1] + 1, []
    for w in words:
        run = w.decode()
        out += [w] if len(run) <= PIECE else [run[i : i + PIECE].encode() for i in range(0, len(run) - GRAMS[1] + 1, step)]
    return out


def gram_table(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of words, and the place of the word that each belongs to; sorted by both.

    A word's letters are lower-cased and punctuation at its ends is dropped; the n-grams include boundary marks, and the whole word counts as one. Nothing remains of punctuation alone.
    """
    marked = [f"<{core}>" if (core := w.strip(_EDGE).decode().lower()) else "" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(sizes.cumsum(), sizes)
    at, found = np.arange(len(code)), []
    h = code.copy()
    for n in range(2, GRAMS[1] + 1):
        h = h[:-1] * _PRIME + code[n - 1 :] if len(h) else h
        if n >= GRAMS[0]:
            here = at[: len(h)] + n <= ends[: len(h)]
            found.append((owner[: len(h)][here], mix64(h[here] + np.uint64(n))))
    full = sizes > 0
    if full.any():
        starts = (sizes.cumsum() - sizes)[full]
        place = (at - np.repeat(sizes.cumsum() - sizes, sizes)).astype(np.uint64)
        found.append((np.flatnonzero(full), mix64(np.add.reduceat(mix64(code * _PRIME + place), starts))))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    keys = distinct(of * buckets + (hashed % np.uint64(buckets)).astype(np.int64))
    return keys % buckets, keys // buckets


def grams(word: bytes) -> list[int]:
    """The n-gram buckets of one word."""
    return gram_table([word])[0].tolist()


class WordLogits(dict):
    """Word bytes to a row of ``sums`` and ``counts``: the parts of its known n-grams and their number. Forgets everything beyond ``most`` words between batches."""

    def __init__(self, weights: np.ndarray, known: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.known, self.most = np.where(known, weights, 0.0), known.astype(np.float64), most
        self.sums, self.counts = array("d"), array("d")

    def meet(self, texts: list[list[bytes]]) -> None:
        """Take in the words of a batch, each new one once."""
        if len(self) > self.most:
            self.clear()
            self.sums, self.counts = array("d"), array("d")
        new = [w for w in set(chain.from_iterable(texts)) if w not in self]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            bucket, of = gram_table(some)
            self.update(zip(some, range(len(self.sums), len(self.sums) + len(some)), strict=True))
            self.sums.frombytes(np.bincount(of, self.weights[bucket], len(some)).tobytes())
            self.counts.frombytes(np.bincount(of, self.known[bucket], len(some)).tobytes())

    def text_logits(self, texts: list[list[bytes]], bias: float) -> np.ndarray:
        self.meet(texts)
        return np.array([self.text_logit(words, bias) for words in texts])

    def text_logit(self, words: list[bytes], bias: float) -> float:
        """The mean logit of the TOP_WINDOWS highest windows of words that were met, missing ones counting as the bias; of an empty text, the bias."""
        if not words:
            return bias
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total, n = (np.concatenate([[0], np.frombuffer(x)[at].cumsum()]) for x in (self.sums, self.counts))
        width = min(SCORE_WINDOW, len(words))
        got = (total[width:] - total[:-width]) / np.maximum(n[width:] - n[:-width], 1)
        if len(got) > TOP_WINDOWS:
            got = np.partition(got, -TOP_WINDOWS)[-TOP_WINDOWS:]
        return float(got.sum() / TOP_WINDOWS + bias)


def _windows(words: list[bytes]) -> list[list[bytes]]:
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)] if words else []


class Bag:
    """Vectors of n-grams and the linear softmax over their average."""

    def __init__(self, rng: np.random.Generator):
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIMS))
        self.weights, self.bias = rng.normal(0, 0.1, (2, DIMS)), np.zeros(2)
        self.steps = [np.full(x.shape, 1e-6) for x in (self.vectors, self.weights, self.bias)]

    def train(self, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int, rate: float = 0.15, batch: int = 512) -> None:
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                ids, sizes = np.concatenate([windows[i] for i in own]), np.array([len(windows[i]) for i in own])
                mean = np.add.reduceat(self.vectors[ids], np.concatenate([[0], sizes.cumsum()[:-1]]), axis=0) / sizes[:, None]
                z = mean @ self.weights.T + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), y[own]] -= 1
                p *= weight[own][:, None]
                back = np.repeat((p @ self.weights) / sizes[:, None], sizes, axis=0)
                grads = (np.stack([np.bincount(ids, back[:, d], BUCKETS) for d in range(DIMS)], axis=1), p.T @ mean, p.sum(axis=0))
                for x, g, s in zip((self.vectors, self.weights, self.bias), grads, self.steps, strict=True):
                    s += g * g
                    x -= rate * g / np.sqrt(s)

    def linear(self) -> tuple[np.ndarray, float]:
        """Each n-gram's part of the logit, and the bias."""
        return self.vectors @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])


def fit(texts: list[str], toxic: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """n-gram logits, which n-grams are known, bias, and the slope and intercept of the score's logistic curve. With fewer than eight texts or one label the score is the label's smoothed share."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if len(texts) < 8 or not 0 < share < 1:
        return np.zeros(BUCKETS), np.zeros(BUCKETS, bool), 0.0, 0.0, float(np.log((share * len(toxic) + 0.5) / ((1 - share) * len(toxic) + 0.5)))
    rng = np.random.default_rng(seed)
    words = [words_of(t) for t in texts]
    fold = rng.permutation(len(texts)) % 4 == 0
    every = sorted({x for i in np.flatnonzero(~fold) for x in words[i]})
    bucket, of = gram_table(every)
    ids = dict(zip(every, np.split(bucket, np.searchsorted(of, np.arange(1, len(every)))), strict=True)) if every else {}
    texts_with = np.zeros(BUCKETS, np.int64)
    for i in np.flatnonzero(~fold):
        if words[i]:
            texts_with[distinct(np.concatenate([ids[w] for w in set(words[i])]))] += 1
    known = texts_with >= LEAST_TEXTS
    ids = {w: x[known[x]] for w, x in ids.items()}
    windows, y, owner = [], [], []
    for i in np.flatnonzero(~fold):
        own = _windows(words[i])
        if not toxic[i] and len(own) > SAMPLE_WINDOWS:
            own = [own[k] for k in rng.choice(len(own), SAMPLE_WINDOWS, replace=False)]
        for w in own:
            joined = np.concatenate([ids[x] for x in w])
            if len(joined):
                windows.append(joined)
                y.append(int(toxic[i]))
                owner.append(i)
    y, owner = np.array(y), np.array(owner)
    bag = Bag(rng)
    even = lambda y: np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    bag.train(windows, y, even(y), rng, 1)
    for _ in range(4):
        parts, bias = bag.linear()
        z = np.array([parts[w].mean() for w in windows]) + bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, z)
        keep = np.flatnonzero((y == 0) | (z >= best[owner] - 0.5 * np.abs(best[owner])))
        bag.train([windows[i] for i in keep], y[keep], even(y[keep]), rng, 1)
    parts, bias = bag.linear()
    table = WordLogits(parts, known)
    z = table.text_logits([words[i] for i in np.flatnonzero(fold)], bias)
    return parts, known, bias, *calibrate(z, toxic[fold].astype(float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, bias, a, b = model.value
        parts = WordLogits(weights, known)
        for batch in batches:
            z = parts.text_logits([words_of(t.as_py()) for t in batch.column(1)], bias)
            score = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["key", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, texts: int = SAMPLE_TEXTS) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Fit on at most ``texts`` texts of each label, chosen by hashed id from the labels alone, so that only the sample's texts are moved.

    Texts that are null or longer than SAMPLE_CHARS, null labels and labels other than 0 and 1 are not used.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct().withColumn("h", F.xxhash64("id"))
    ids = rows.withColumn("turn", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).where(F.col("turn") <= texts)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"length(text) between 1 and {SAMPLE_CHARS}")
    got = known.join(F.broadcast(ids), "id").groupBy("y", "h", "id").agg(F.min("text").alias("text")).orderBy("y", "h", "id").collect()
    return fit([r.text for r in got], np.array([r.y for r in got], int))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 if score >= threshold, else 0).

    ``labels`` gives ids of docs with labels 0 and 1 to learn from. Null, empty and wordless texts get the score of the bias alone. Whole texts are scored, words of any length
    in full; equal scores need no rule.
    Repeated rows score alike, null ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = keyed.mapInArrow(_score(model), f"key {keyed.schema['key'].dataType.simpleString()}, score double")
    return out.select(F.col("key").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def evaluated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: labels off the evaluation fold are learned from, all texts are scored."""
    out = score_toxicity(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
