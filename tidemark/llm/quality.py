"""Quality classifier on supervised subword embeddings.

A document is the mean of the learned vectors of its features: hashed words,
hashed character n-grams (of bytes, with the word's ends marked), and a mark
for each word that repeats the one before it or ends a three-word run met
before in the text.  A softmax of that mean gives the score.  Vectors and
softmax are trained by stochastic gradient descent in numpy.  A feature's row
moves along its gradient at a rate of its own: fifty times the common one, but
so that no step exceeds that of a text of one feature.

The softmax is linear in the mean, so scoring needs one number per feature:
the vectors are folded into them when training ends.

Null texts count as empty; an empty text has the score of the bias.  Every
input row gives one row; ids may be null or repeated.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import crc_of_id, prepare
from tidemark.llm.textvec import chunks, factorize, mix, segment_sums, span_hashes, words
from tidemark.llm.training import fit, labelled

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)
#: The last buckets are the marks of repetition.
AGAIN, SEEN = BUCKETS, BUCKETS + 1
U64 = np.uint64


def _ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the buckets of the words' n-grams one after another, and where each word's begin."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1  # of the blank before each word
    value = joined.astype(np.uint64) + U64(1)
    for n in NGRAMS:
        many = np.maximum(lengths + 2 - n + 1, 0)
        ends = np.cumsum(many)
        at = np.repeat(begin - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * U64(0x100000001B3) + value[at + k]
        yield (mix(h) % U64(BUCKETS)).astype(np.int64), np.concatenate([[0], ends])


def word_features(texts: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each distinct word one after another, and where each word's begin."""
    found, owner = [(hashes % U64(BUCKETS)).astype(np.int64)], [np.arange(len(texts))]
    for buckets, begin in _ngrams(texts):
        found.append(buckets)
        owner.append(np.repeat(np.arange(len(texts)), np.diff(begin)))
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(who[order], np.arange(len(texts) + 1))


def word_values(texts: list[bytes], hashes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the features of each word of their values, and how many they are."""
    total = value[(hashes % U64(BUCKETS)).astype(np.int64)].astype(np.float64)
    many = np.ones(len(texts), np.int64)
    for buckets, begin in _ngrams(texts):
        total += segment_sums(value[buckets], begin)
        many += np.diff(begin)
    return total, many


class Words:
    """The words of one chunk of texts: codes of distinct words, their features, and repetition marks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, self.first = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        self.codes, where = factorize(hashes)
        raw = data.tobytes()
        self.texts = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        self.hashes = hashes[where]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.again = np.zeros(len(hashes), bool)
        self.again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        self.seen = np.zeros(len(hashes), bool)
        if len(hashes) > 2:
            import pandas as pd

            run = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:] + text[2:].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            # runs across two texts are none, and must not stand for a first one either
            inside = np.flatnonzero(text[2:] == text[:-2])
            self.seen[inside + 2] = pd.Series(run[inside]).duplicated().to_numpy()

    def learn(self) -> "Words":
        self.features, self.begin = word_features(self.texts, self.hashes)
        return self

    def document(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text, and their shares."""
        a, b = self.first[i], self.first[i + 1]
        codes, times = np.unique(self.codes[a:b], return_counts=True)
        size = self.begin[codes + 1] - self.begin[codes]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[codes] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        marks = [(AGAIN, int(self.again[a:b].sum())), (SEEN, int(self.seen[a:b].sum()))]
        ids = np.concatenate([self.features[at], [m for m, _ in marks]])
        weight = np.concatenate([np.repeat(times, size), [n for _, n in marks]]).astype(np.float64)
        total = np.bincount(ids, weight, BUCKETS + 2) if len(ids) > BUCKETS else None
        if total is None:
            order = np.argsort(ids, kind="stable")
            ids, weight = ids[order], weight[order]
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ids, weight = ids[start], np.add.reduceat(weight, start)
        else:
            ids = np.flatnonzero(total)
            weight = total[ids]
        all_ = weight.sum()
        keep = weight > 0
        return ids[keep].astype(np.int32), (weight[keep] / max(all_, 1)).astype(np.float32)

    def logits(self, value: np.ndarray) -> np.ndarray:
        """Mean over each text's features of the value of a feature."""
        of_word, count = word_values(self.texts, self.hashes, value)
        total = segment_sums(of_word[self.codes] + self.again * float(value[AGAIN]) + self.seen * float(value[SEEN]), self.first)
        many = segment_sums(count[self.codes] + self.again.astype(np.int64) + self.seen, self.first)
        return total / np.maximum(many, 1)


def sgd(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """The folded value of each feature, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
    bias[:] = np.log(1 - share) / 2, np.log(share) / 2
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            step = rate * (1 - done / steps)
            done += 1
            ids, weight = docs[k]
            hidden = weight @ vectors[ids]
            z = out @ hidden + bias
            z = np.exp(z - z.max())
            wrong = z / z.sum()
            wrong[labels[k]] -= 1
            back = wrong @ out
            out -= step * np.outer(wrong, hidden)
            bias -= 0.05 * step * wrong
            # the gradient of a row is its share times ``back``; its rate is min(50, 1 / share) times the common one
            vectors[ids] -= step * np.minimum(weight * 50, 1)[:, None] * back[None, :]
    fold = out[1] - out[0]
    return vectors @ fold, float(bias[1] - bias[0])


def train_quality(docs: DataFrame, labels: DataFrame, size: int = 4000, dim: int = 16, epochs: int = 4, rate: float = 1.0, seed: int = 11) -> bytes:
    """A model from at most ``size`` labelled documents whose crc32 of the id, modulo 3, isn't 1."""
    sample = labelled(docs, labels, "quality", crc_of_id() % 3 != 1, size)

    def train(batches: Iterator[pa.RecordBatch]) -> bytes:
        items, marks = [], []
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(3)):
                w = Words(data, offsets).learn()
                items += [w.document(i) for i in range(b - a)]
            marks += batch.column(1).to_pylist()
        value, bias = sgd(items, np.array(marks, np.int64), dim, epochs, rate, seed)
        out = io.BytesIO()
        np.savez(out, value=value.astype(np.float32), bias=bias)
        return out.getvalue()

    return fit(sample, train)


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), score and predicted of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = np.load(io.BytesIO(shared.value))
        value, bias = loaded["value"], float(loaded["bias"])
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                score = 1 / (1 + np.exp(-np.clip(Words(data, offsets).logits(value) + bias, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "text_key", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, score double, predicted int")


def keep_good(docs: DataFrame, model: bytes) -> DataFrame:
    """The documents with a score of 0.5 or more, in all their columns, without a shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = np.load(io.BytesIO(shared.value))
        value, bias = loaded["value"], float(loaded["bias"])
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(Words(data, offsets).logits(value) + bias >= 0))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out (crc32 of the id, modulo 3, is 1), score and predicted of every row."""
    scored = score_quality(docs, train_quality(docs, labels, **options))
    return scored.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")
