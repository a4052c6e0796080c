"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE consecutive words. A passage is encoded from counts over its words (case,
punctuation, digits, repetition, lengths, hashed words); gated attention, learned from the labels of
documents alone, weighs the passages, and the weighted sum of their encodings is scored. The model is fitted
on the driver from ``fit_rows`` labelled documents at most, all passages of each, which are counted on the executors; it has a fixed size
and is broadcast. Every passage of every document is scored.

Defined results: null and empty texts are one empty passage and get a score; rows with a null key are scored and are
never held out nor learned from; repeated keys each give a row; of several labels of a key the lowest counts; without
labels of both kinds every score is the share of label 1 (0.5 if there are none); an empty table gives an empty table; a very long
text is as many passages as it needs, each of N_FEATURES numbers; other columns stay, but for one named like the score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import find_words, slices, text_bytes, word_hashes

PASSAGE = 64
BUCKETS = 64
LAGS = 5
WIDTH, GATE = 32, 16
FOLDS = 5
THRESHOLD = 0.3
#: Labels (three numbers each) that are broadcast at most.
MOST_BROADCAST = 500_000

_CODES = np.arange(256)
_IS = {
    "upper": (_CODES >= 65) & (_CODES <= 90),
    "letter": ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128),
    "digit": (_CODES >= 48) & (_CODES <= 57),
}
_IS["mark"] = (_CODES >= 33) & ~(_IS["upper"] | _IS["letter"] | _IS["digit"])
N_FEATURES = 13 + LAGS + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean features of each passage of each text in order, and the number of passages before each text, and of all."""
    data, offsets = text_bytes(texts)
    begins, ends, firsts = find_words(data, offsets)
    words = word_hashes(data, begins, ends)
    sizes = np.diff(firsts)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    starts = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = starts[text] + (np.arange(len(words)) - firsts[text]) // PASSAGE
    n = int(starts[-1])
    per = np.maximum(1, np.bincount(place, minlength=n))
    held = {}
    for name, table in _IS.items():
        sums = np.r_[0, np.cumsum(table[data], dtype=np.int32)]
        held[name] = sums[ends] - sums[begins]
    length = (ends - begins).astype(np.float32)
    first, last = data[begins] if len(words) else data[:0], data[ends - 1] if len(words) else data[:0]
    columns = [
        np.ones(len(words), np.float32) / 8,
        np.minimum(length, 40) / 10,
        length > 25,
        (held["upper"] > 1) & (held["letter"] == 0),
        _IS["upper"][first],
        held["letter"] + held["upper"] == 0,
        held["digit"] > 0,
        held["mark"] / length,
        held["mark"] > 1,
        held["mark"] > 2,
        _IS["mark"][first],
        _IS["mark"][last],
        np.isin(last, np.frombuffer(b".,;:!?", np.uint8)),
    ]
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(words), bool)
        same[lag:] = (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])
        columns.append(same)
    out = np.empty((n, N_FEATURES), np.float32)
    for k, column in enumerate(columns):
        out[:, k] = np.bincount(place, weights=column, minlength=n)
    bucket = (words >> np.uint64(58)).astype(np.int64)
    out[:, len(columns) :] = np.bincount(place * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out / per[:, None].astype(np.float32), starts


class Model:
    """Encoder, gated attention and output; float32 arrays of fixed sizes."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.weights = [start(N_FEATURES, WIDTH), np.zeros(WIDTH, np.float32), start(WIDTH, GATE), start(WIDTH, GATE), start(GATE), start(WIDTH), np.zeros(1, np.float32)]
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        encode, bias, value, gate, attend, output, shift = self.weights
        at = starts[:-1]
        text = np.repeat(np.arange(len(at)), np.diff(starts))
        h = np.tanh(((x - self.mean) / self.scale) @ encode + bias)
        a = np.tanh(h @ value)
        g = 1 / (1 + np.exp(-(h @ gate)))
        s = (a * g) @ attend
        e = np.exp(s - np.maximum.reduceat(s, at)[text])
        alpha = e / np.add.reduceat(e, at)[text]
        z = np.add.reduceat(alpha[:, None] * h, at)
        p = 1 / (1 + np.exp(-np.clip(z @ output + shift, -30, 30)))
        return text, h, a, g, alpha, z, p

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts) - 1, self.constant)
        return self.forward(x, starts)[-1].astype(np.float64) if len(starts) > 1 else np.zeros(0)

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        encode, bias, value, gate, attend, output, shift = self.weights
        text, h, a, g, alpha, z, p = self.forward(x, starts)
        d = ((p - y) / len(y)).astype(np.float32)
        dz = d[:, None] * output
        d_alpha = (dz[text] * h).sum(1)
        ds = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, starts[:-1])[text])
        d_gated = ds[:, None] * attend
        da, dg = d_gated * g * (1 - a * a), d_gated * a * g * (1 - g)
        dh = alpha[:, None] * dz[text] + da @ value.T + dg @ gate.T
        pre = dh * (1 - h * h)
        scaled = (x - self.mean) / self.scale
        return [scaled.T @ pre, pre.sum(0), h.T @ da, h.T @ dg, (a * g).T @ ds, z.T @ d, d.sum(keepdims=True)]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.005, decay: float = 1e-4) -> Model:
        """Adam over shuffled batches of documents."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + np.float32(0.02)
        rng = np.random.default_rng(2)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for b in range(0, len(order), batch):
                chosen = order[b : b + batch]
                starts = np.r_[0, np.cumsum([len(bags[i]) for i in chosen])]
                step += 1
                for k, g in enumerate(self.gradient(np.concatenate([bags[i] for i in chosen]), starts, labels[chosen])):
                    g = g + decay * self.weights[k]
                    m, v = moments[k] = (0.9 * moments[k][0] + 0.1 * g, 0.999 * moments[k][1] + 0.001 * g * g)
                    self.weights[k] = (self.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(key: Column) -> Column:
    """Whether a key is of the fold that is not learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int) -> Model:
    """A model of the ``fit_rows`` labelled documents with the least hashes of their keys. The driver holds all their passages, in
    half precision."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    known = known.select("key", "label", F.xxhash64("key").alias("order"))
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, length in slices(batch.column(3)):
                part = batch.slice(begin, length)
                x, starts = passages(part.column(3))
                bags = [x[b:e].astype(np.float16).tobytes() for b, e in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(bags, pa.binary())], ["order", "key", "label", "bag"])

    asked = 2 * fit_rows
    while True:
        some = known.orderBy("order", "key").limit(asked)
        rows = slim.join(F.broadcast(some) if asked <= MOST_BROADCAST else some, "key").select("order", "key", "label", "text")
        kinds = dict(rows.dtypes)
        bags = rows.mapInArrow(count, f"order long, key {kinds['key']}, label {kinds['label']}, bag binary")
        found = bags.orderBy("order", "key", "bag").limit(fit_rows).collect()
        # labels without a document are made up for by further ones, until there are none
        if len(found) == fit_rows or known.limit(asked + 1).count() <= asked:
            break
        asked *= 16
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in found]
    return Model().fit(bags, np.array([float(r["label"] == 1) for r in found], np.float32))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 2000, name: str = "score") -> DataFrame:
    """``docs`` with the likelihood of label 1 in column ``name``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, fit_rows))

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts:
            for begin, length in slices(batch.column(at)):
                part = batch.slice(begin, length)
                scores = model.value.score(*passages(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names)

    plain = docs.drop(name)
    names, at = [*plain.columns, name], plain.columns.index(text)
    kinds = ", ".join(f"`{n}` {k}" for n, k in plain.dtypes)
    return plain.mapInArrow(run, f"{kinds}, `{name}` double")


def digest(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The fold, the score and the prediction."""
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
