"""Scores of the trained models against plain computations, one text and one word at a time."""

import io
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.textvec import hash_words
from tidemark.llm.training import fit

SCHEMA = "doc_id long, text string, lang string, score string, predicted int"
M64 = (1 << 64) - 1


def texts():
    r = random.Random(7)
    words = ["good", "bad", "Ärger", "naïve", "x", "the", "AND", "don't", "1984", "日本", "e-mail", "vile", "nice", "..."]
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(120)]
    return [*made, "", None, " \n", "x", "x", "good good good good", "word " * 5000, "vile " * 3 + "日" * 3000]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en" if k % 2 else None, "mine", 1) for k, t in enumerate(rows)], SCHEMA)


def labels(spark, rows, word):
    return spark.createDataFrame([(k, int(word in (t or "").lower().split())) for k, t in enumerate(rows)], "doc_id long, mark int").selectExpr("doc_id", "mark quality", "mark toxic")


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_quality(text, value, bias):
    """The mean over words, their n-grams and marks of repetition, plainly."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    total, many, seen = 0.0, 0, set()
    for k, w in enumerate(words):
        found = [int(hash_words([w])[0]) % quality.BUCKETS]
        marked = b" " + w + b" "
        for n in quality.NGRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for b in marked[i : i + n]:
                    h = (h * 0x100000001B3 + b + 1) & M64
                found.append(mix(h) % quality.BUCKETS)
        if k and words[k - 1] == w:
            found.append(quality.AGAIN)
        if k > 1:
            run = tuple(words[k - 2 : k + 1])
            if run in seen:
                found.append(quality.SEEN)
            seen.add(run)
        total += sum(float(value[f]) for f in found)
        many += len(found)
    return 1 / (1 + math.exp(-(total / max(many, 1) + bias)))


def plain_toxicity(text, row, net):
    """Each filter at each place of the text, its largest value, and the output."""
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text or "")]
    x = [net.vectors[row[int(hash_words([w.encode()])[0]) % toxicity.BUCKETS]].astype(float) for w in words]
    hidden = []
    for w, kernel in enumerate(net.kernels):
        for f in range(toxicity.FILTERS):
            best = max((sum(float(x[i + p] @ kernel[p, :, f]) for p in range(len(kernel)) if i + p < len(x)) for i in range(len(x))), default=None)
            hidden.append(0.0 if best is None else max(0.0, best + float(net.bias[w * toxicity.FILTERS + f])))
    return 1 / (1 + math.exp(-(float(np.dot(hidden, net.out[:-1])) + float(net.out[-1]) + net.shift)))


def test_quality_scores_against_plain_ones(spark):
    rows = texts()
    df = frame(spark, rows)
    model = quality.train_quality(df, labels(spark, rows, "good"), epochs=2)
    loaded = np.load(io.BytesIO(model))
    got = quality.score_quality(df, model).collect()
    assert [x.doc_id for x in got] == list(range(len(rows)))
    for x, t in zip(got, rows, strict=True):
        assert x.score == pytest.approx(plain_quality(t, loaded["value"], float(loaded["bias"])), abs=1e-6), t
        assert x.predicted == (x.score >= 0.5)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and [x.doc_id for x in kept.collect()] == [x.doc_id for x in got if x.score >= 0.5]


def test_toxicity_scores_against_plain_ones(spark):
    rows = texts()
    df = frame(spark, rows)
    model = toxicity.train_toxicity(df, labels(spark, rows, "vile"), epochs=2)
    row, net, cuts = toxicity.load(model)
    net.bias[:] = np.abs(net.bias) + 0.1  # a bias that shows, also in texts without words
    out = io.BytesIO()
    x = dict(np.load(io.BytesIO(model)))
    np.savez(out, **(x | {"bias": net.bias}))
    got = toxicity.score_toxicity(df, out.getvalue()).collect()
    for x, t in zip(got, rows, strict=True):
        assert x.score == pytest.approx(plain_toxicity(t, row, net), abs=2e-5), t
    empty = {x.score for x, t in zip(got, rows, strict=True) if not (t or "").strip()}
    alone = toxicity.score_toxicity(frame(spark, ["", None]), out.getvalue()).collect()
    assert len(empty | {x.score for x in alone}) == 1  # whatever stands beside it
    assert all(x.flagged == (x.score >= x.lang_threshold) for x in got)


def test_quality_steps_follow_the_gradient():
    """One step of the descent against the loss's numeric slope: each row moves along it at its documented rate."""
    r = np.random.default_rng(3)
    ids, weight, dim = np.array([1, 4, 9], np.int32), np.array([0.01, 0.09, 0.9], np.float32), 4

    def loss(vectors, out):
        z = out @ (weight.astype(float) @ vectors)
        return math.log(np.exp(z).sum()) - z[1]

    vectors, out = r.normal(size=(3, dim)), r.normal(size=(2, dim))
    z = out @ (weight.astype(float) @ vectors)
    wrong = np.exp(z) / np.exp(z).sum() - [0, 1]
    for i in range(3):
        for d in range(dim):
            moved = vectors.copy()
            moved[i, d] += 1e-6
            assert (loss(moved, out) - loss(vectors, out)) / 1e-6 == pytest.approx(weight[i] * (wrong @ out)[d], abs=1e-4)
    value, bias = quality.sgd([(ids, weight)] * 40, np.ones(40, np.int64), dim, 3, 1.0, 0)
    assert float(weight @ value[ids]) + bias > 2  # the one label is learned


def test_a_sample_is_read_up_to_a_size(spark):
    rows = frame(spark, ["é" * 50] * 20).selectExpr("doc_id", "1 label", "lang", "text")
    for most, want in ((10**6, 20), (1000, 10), (99, 0)):
        assert int(fit(rows, lambda batches: str(sum(b.num_rows for b in batches)).encode(), most)) == want
    assert fit(rows.limit(0), lambda batches: str(sum(b.num_rows for b in batches)).encode()) == b"0"


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Every labelled text counts, in one part or in many, and the model doesn't depend on the tasks' order."""
    r = random.Random(4)
    rows = [" ".join([r.choice(["vile", "nice"]), f"only{k}", f"only{k}"]) for k in range(8600)]
    df, marks = frame(spark, rows), labels(spark, rows, "vile").filter("doc_id % 2 = 0 or doc_id < 8590").unionByName(labels(spark, rows[:3], "nice"))
    counted = []
    odds = toxicity.word_odds
    monkeypatch.setattr(toxicity, "word_odds", lambda found: (counted.append((found.count(), found.select("part").distinct().count(), found.filter("held").count())), odds(found))[1])
    want = sum(zlib.crc32(str(x.doc_id).encode()) % 5 != 0 for x in marks.select("doc_id").distinct().collect())
    models = [toxicity.train_toxicity(df, marks, epochs=1, part=part) for part in (100_000, 1000, 1000)]
    assert want > 6500 and [n for n, _, _ in counted] == [want] * 3 and [p for _, p, _ in counted] == [1, -(-want // 1000), -(-want // 1000)]
    assert all(want // 6 < n < want // 4 for _, _, n in counted)
    assert models[1] == models[2]
    for model in models[:2]:
        got = toxicity.score_toxicity(df, model).collect()
        assert sum(x.predicted == ("vile" in t) for x, t in zip(got, rows, strict=True)) > 8500
