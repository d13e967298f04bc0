"""Toxicity by a small convolutional network over words.

Words (runs of ASCII letters and digits and of other bytes, ASCII letters in
lower case) are hashed to learned embeddings; filters of several widths pass
over them, the largest value of each filter over the text goes into a logistic
output.  Training is numpy (Adam, minibatches) over all labelled texts, in parts
whose networks are averaged after each epoch.  The first coordinate of an
embedding starts as the word's smoothed log odds.  Words met in fewer than
``LEAST`` texts trained on have the zero vector, which is also what unknown
words have.

A fifth of them isn't trained on but calibrates: the score is shifted so
that 0.5 is the best single threshold, and each language has a threshold of its
own for ``flagged``.  The score doesn't depend on the language.

Null texts count as empty; every input row gives one row; ids may be null or
repeated; rows without a language use the common threshold.
"""

from __future__ import annotations

import copy
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import crc_of_id, cut_lineage, prepare
from tidemark.llm.textvec import chunks, span_hashes
from tidemark.llm.training import all_labelled

BUCKETS = 1 << 18
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
LEAST = 3
#: Words that a training task holds at once; steps of a logit in calibration; unit of summed changes.
HELD_AT_ONCE, GRID, SCALE = 2_000_000, 1024, 2.0**40
U64 = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _a, _b in ("09", "AZ", "az"):
    _INSIDE[ord(_a) : ord(_b) + 1] = True


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts, and where each text's begin."""
    data = _FOLD[data]
    inside = np.concatenate([_INSIDE[data], [False]])
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-2]])
    starts = np.flatnonzero(inside[:-1] & (~before | edge[:-1]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    return (span_hashes(data, starts, ends) % U64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


class Network:
    def __init__(self, vectors: np.ndarray, kernels: list[np.ndarray], bias: np.ndarray, out: np.ndarray, shift: float) -> None:
        self.vectors, self.kernels, self.bias, self.out, self.shift = vectors, kernels, bias, out, shift

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.kernels, self.bias, self.out]

    def folded(self) -> list[list[np.ndarray]]:
        """For each width and place within the filter, what each row of the embeddings gives."""
        return [[self.vectors @ k[p] for p in range(len(k))] for k in self.kernels]

    def features(self, rows: np.ndarray, first: np.ndarray, folded: list[list[np.ndarray]]) -> np.ndarray:
        """Largest value of each filter over each text; texts shorter than a filter are padded with zeros."""
        n = len(first) - 1
        many = np.diff(first)
        some = np.flatnonzero(many)
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        if not len(some):
            return out
        for w, places in enumerate(folded):
            value = places[0][rows]
            for p in range(1, len(places)):
                value[:-p] += places[p][rows[p:]] * (np.repeat(first[1:], many)[:-p] > np.arange(len(rows) - p) + p)[:, None]
            out[some, w * FILTERS : (w + 1) * FILTERS] = np.maximum.reduceat(value, first[some], axis=0)
        out[some] = np.maximum(out[some] + self.bias, 0)  # a text without words has no window, in training neither
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out[:-1] + self.out[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def start(known: np.ndarray, odds: np.ndarray, seed: int) -> Network:
    """A network whose row 0 is the unknown word and row k + 1 known[k]."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((len(known) + 1, DIM), np.float32)
    vectors[1:] = rng.normal(0, 0.05, (len(known), DIM))
    vectors[1:, 0] = odds
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0, :] = np.abs(k[:, 0, :]) + 0.3
    return Network(vectors, kernels, rng.uniform(-0.5, 0, len(WIDTHS) * FILTERS).astype(np.float32), np.append(np.full(len(WIDTHS) * FILTERS, 0.1), -1).astype(np.float32), 0.0)


def descend(net: Network, state: list[tuple[np.ndarray, np.ndarray]], step: int, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float, batch: int = 32) -> int:
    """Pass once over the texts (rows of the embeddings), in their order; the number of steps so far."""
    for at in range(0, len(texts), batch):
        grads = [np.zeros_like(p) for p in net.parameters()[1:]]
        for i in range(at, min(at + batch, len(texts))):
            t = texts[i]
            if not len(t):
                grads[-1][-1] += weight[i] * (1 / (1 + np.exp(-net.out[-1])) - labels[i])
                continue
            x = net.vectors[t]
            tops, values = [], []
            for k in net.kernels:
                v = x @ k[0]
                for p in range(1, len(k)):
                    v[:-p] += x[p:] @ k[p]
                tops.append(v.argmax(axis=0))
                values.append(v[tops[-1], np.arange(FILTERS)])
            pre = np.concatenate(values) + net.bias
            hidden = np.maximum(pre, 0)
            z = hidden @ net.out[:-1] + net.out[-1]
            wrong = weight[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i])
            grads[-1][:-1] += wrong * hidden
            grads[-1][-1] += wrong
            back = wrong * net.out[:-1] * (pre > 0)
            grads[-2] += back
            for w, k in enumerate(net.kernels):
                g = back[w * FILTERS : (w + 1) * FILTERS]
                for f in np.flatnonzero(g).tolist():
                    top = tops[w][f]
                    for p in range(min(len(k), len(t) - top)):
                        r = t[top + p]
                        grads[w][p, :, f] += g[f] * net.vectors[r]
                        if r:
                            net.vectors[r] -= rate * g[f] * k[p, :, f]
        step += 1
        for p, g, (m, v) in zip(net.parameters()[1:], grads, state, strict=True):
            g /= batch
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return step


def best_threshold(score: np.ndarray, labels: np.ndarray, times: np.ndarray | int = 1) -> float:
    """Logit cut of fewest errors; between ties the middle one, 0 where one class is missing.  ``times``: how often each entry counts."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(score)
    s, y, n = score[order], (labels * times)[order], ((1 - labels) * times)[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (n.sum() - np.concatenate([[0], np.cumsum(n)]))
    errors[1:-1][s[1:] == s[:-1]] = y.sum() + n.sum() + 1
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = s[max(k - 1, 0)], s[min(k, len(s) - 1)]
    return float((low + high) / 2 if 0 < k < len(s) else low - 0.5 if k == 0 else high + 0.5)


def _stream(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Part, texts (buckets), labels and languages of the rows that are held or aren't, at most ``HELD_AT_ONCE`` words or so at a time."""
    key, texts, marks, langs, many = None, [], [], [], 0
    for batch in batches:
        part, label, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        lang, ids = batch.column(3), batch.column(4)
        first, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        for r in np.flatnonzero(own == held).tolist():
            if texts and (part[r] != key or many > HELD_AT_ONCE):
                yield key, texts, np.array(marks), np.array(langs)
                texts, marks, langs, many = [], [], [], 0
            key = int(part[r])
            texts.append(values[first[r] : first[r + 1]].copy())
            marks.append(int(label[r]))
            langs.append(lang[r].as_py())
            many += len(texts[-1])
    if texts:
        yield key, texts, np.array(marks), np.array(langs)


def _rows_of(known: np.ndarray) -> np.ndarray:
    row = np.zeros(BUCKETS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    return row


def hashed_rows(sample: DataFrame, parts: int) -> DataFrame:
    """part, label, held, lang and ids (buckets of the words) of each text, written in a fixed order within parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(3)):
                ids, first = hashed(data, offsets)
                ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), ids], ["doc_id", "label", "lang", "ids"])

    rows = sample.mapInArrow(run, "doc_id long, label int, lang string, ids array<int>")
    draw = lambda k: F.xxhash64("doc_id", F.lit(k))
    rows = rows.select(F.pmod(draw(1), F.lit(parts).cast("long")).cast("int").alias("part"), "label", (F.pmod(draw(2), F.lit(5).cast("long")) == 4).alias("held"), "lang", "ids", draw(3).alias("h"), "doc_id")
    # more tasks than parts, so that few tasks have two of them
    rows = rows.repartition(4 * parts, "part").sortWithinPartitions("part", "h", "doc_id")
    return cut_lineage(rows.select("part", "label", "held", "lang", "ids"))


def word_odds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets met in at least ``LEAST`` texts, their smoothed log odds against the prior, and the labels' mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place counts the texts
        seen, bad = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for _, texts, marks, _ in _stream(batches, False):
            for t, y in zip(texts, marks.tolist(), strict=True):
                t = np.append(np.unique(t), BUCKETS)
                seen[t] += 1
                bad[t] += y
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(bad[at])], ["at", "seen", "bad"])

    found = rows.mapInArrow(run, "at long, seen long, bad long").groupBy("at").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    found = cut_lineage(found).orderBy("at").toArrow()  # at most BUCKETS + 1 rows
    at, seen, bad = (c.to_numpy() for c in found.columns)
    mean = float(bad[-1] / seen[-1]) if len(at) else 0.5
    take = (seen >= LEAST) & (at < BUCKETS)
    prior = np.clip(mean, 0.01, 0.99)
    share = (bad[take] + 2 * prior) / (seen[take] + 2)
    return at[take], np.log(share / (1 - share)) - np.log(prior / (1 - prior)), mean


def _flat(net: Network, state: list[tuple[np.ndarray, np.ndarray]], step: float) -> np.ndarray:
    """All but the embeddings, in rows of ``DIM`` numbers."""
    flat = np.concatenate([x.ravel() for x in net.parameters()[1:]] + [x.ravel() for pair in state for x in pair] + [np.array([step])]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _fill(net: Network, state: list[tuple[np.ndarray, np.ndarray]], flat: np.ndarray) -> int:
    at, flat = 0, flat.ravel()
    for x in net.parameters()[1:] + [x for pair in state for x in pair]:
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    for _, v in state:
        np.maximum(v, 0, out=v)
    return round(flat[at])


def one_epoch(rows: DataFrame, known: np.ndarray, net: Network, state: list[tuple[np.ndarray, np.ndarray]], step: int, mean: float, rate: float, seed: int) -> int:
    """Train each part from the same network, and put the mean of the changes into it.

    An embedding changes by the mean over the parts that change it.  Changes are
    summed as integers, so that the order of the tasks doesn't matter.
    """
    shared = rows.sparkSession.sparkContext.broadcast((known, net, state, step))  # at most BUCKETS rows, whatever the data
    weights = np.array([0.5 / max(1 - mean, 0.02), 0.5 / max(mean, 0.02)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, *_ = shared.value
        row = _rows_of(known)
        began = _flat(*shared.value[1:])

        def change() -> pa.RecordBatch:
            moved = np.flatnonzero((own.vectors != first.vectors).any(axis=1))
            dense = _flat(own, own_state, n) - began
            place = np.concatenate([moved, -1 - np.arange(len(dense))])
            delta = np.concatenate([own.vectors[moved].astype(np.float64) - first.vectors[moved], dense])
            delta = np.round(delta * SCALE).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(np.ascontiguousarray(delta[:, k])) for k in range(DIM)]], ["place", *names])

        key = None
        for part, texts, marks, _ in _stream(batches, False):
            if part != key:
                if key is not None:
                    yield change()
                key, (own, own_state, n) = part, copy.deepcopy(shared.value[1:])
                rng = np.random.default_rng([seed, n, part])
            order = rng.permutation(len(texts))
            n = descend(own, own_state, n, [row[texts[i]] for i in order.tolist()], marks[order], weights[marks[order]], rate)
        if key is not None:
            yield change()

    names = [f"d{k}" for k in range(DIM)]
    made = rows.mapInArrow(run, "place long, " + ", ".join(f"{c} long" for c in names))
    made = cut_lineage(made.groupBy("place").agg(F.count("*").alias("many"), *[F.sum(c).alias(c) for c in names])).toArrow()
    shared.unpersist()
    place, many = made.column("place").to_numpy(), made.column("many").to_numpy()
    delta = np.stack([made.column(c).to_numpy() for c in names], axis=1) / SCALE / many[:, None]
    net.vectors[place[place > 0]] += delta[place > 0].astype(np.float32)
    flat = _flat(net, state, step)
    flat[-1 - place[place < 0]] += delta[place < 0]
    return _fill(net, state, flat)


def calibrate(rows: DataFrame, known: np.ndarray, net: Network) -> tuple[list[str], list[float]]:
    """Shift the score, and give languages and their thresholds, by all rows that are held; logits are rounded to ``1 / GRID``."""
    shared = rows.sparkSession.sparkContext.broadcast((known, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        row, folded = _rows_of(known), net.folded()
        for _, texts, marks, langs in _stream(batches, True):
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            z = net.features(row[np.concatenate(texts)], first, folded) @ net.out[:-1] + net.out[-1]
            at = np.round(np.clip(z.astype(np.float64), -40, 40) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(langs.tolist(), pa.string()), pa.array(at), pa.array(marks.astype(np.int64))], ["lang", "at", "label"])

    found = rows.mapInArrow(run, "lang string, at long, label long").groupBy("lang", "at", "label").agg(F.count("*").alias("n"))
    found = cut_lineage(found).orderBy("lang", "at", "label").toArrow()  # at most 80 GRID numbers for each language and label
    shared.unpersist()
    where, (at, y, n) = np.array(found.column("lang").to_pylist()), (found.column(c).to_numpy() for c in ("at", "label", "n"))
    z = at / GRID
    net.shift = -best_threshold(z, y, n)
    names, cuts = [], []
    for g in sorted(set(where.tolist())):
        own = where == g
        if g and (n * y)[own].sum() >= 5:
            names.append(g)
            cuts.append(1 / (1 + np.exp(-(best_threshold(z[own], y[own], n[own]) + net.shift))))
    return names, cuts


def train_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 4, rate: float = 0.01, seed: int = 5, part: int = 8000, most_parts: int = 256) -> bytes:
    """A model from all labelled documents whose crc32 of the id, modulo 5, isn't 0.

    They are trained on in parts of about ``part`` rows, of more where there
    would be over ``most_parts``; after each epoch the parts' networks become one.
    """
    prepare(docs.sparkSession)
    sample, many = all_labelled(docs, labels, "toxic", crc_of_id() % 5 != 0)
    rows = hashed_rows(sample, min(most_parts, max(1, -(-many // part))))
    known, odds, mean = word_odds(rows)
    net = start(known, odds, seed)
    state, step = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()[1:]], 0
    for _ in range(epochs):
        step = one_epoch(rows, known, net, state, step, mean, rate, seed)
    names, cuts = calibrate(rows, known, net)
    out = io.BytesIO()
    np.savez(out, known=known.astype(np.int32), vectors=net.vectors, bias=net.bias, out=net.out, shift=net.shift, langs=np.array(names, "U16"), cuts=np.array(cuts, float), **{f"k{w}": k for w, k in enumerate(net.kernels)})
    return out.getvalue()


def load(model: bytes) -> tuple[np.ndarray, Network, dict[str, float]]:
    x = np.load(io.BytesIO(model))
    row = np.zeros(BUCKETS, np.int32)
    row[x["known"]] = np.arange(1, len(x["known"]) + 1)
    net = Network(x["vectors"], [x[f"k{w}"] for w in range(len(WIDTHS))], x["bias"], x["out"], float(x["shift"]))
    return row, net, dict(zip(x["langs"].tolist(), x["cuts"].tolist(), strict=True))


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), lang_threshold and flagged (score >= it) of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS rows, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, net, _ = load(shared.value)
        folded = net.folded()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2), 1 << 20):
                ids, first = hashed(data, offsets)
                score = net.score(net.features(row[ids], first, folded))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "lang", "score", "predicted"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, lang string, score double, predicted int")
    threshold = F.lit(0.5)
    for g, cut in load(model)[2].items():
        threshold = F.when(F.col("lang") == g, F.lit(float(cut))).otherwise(threshold)
    return scored.select("doc_id", "score", "predicted", threshold.alias("lang_threshold")).withColumn("flagged", F.col("score") >= F.col("lang_threshold"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out (crc32 of the id, modulo 5, is 0), score, predicted, lang_threshold and flagged of every row."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, **options))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted", "lang_threshold", "flagged")
