import random
import time
from pathlib import Path

import numpy as np

from tidemark.llm import simhash
from tidemark.llm.graph import components
from tidemark.llm.simhash import near_duplicates

SCHEMA = "doc_id long, text string, node string"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def brute(rows, similarity=0.8):
    def shingle(t):
        w = (t or "").replace("\x0b", " ").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingle(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = [None] * len(rows)
    for g in groups.values():
        least = min(rows[i][0] for i in g)
        for i in g:
            out[i] = least
    return out


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, at = [], 0
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 200))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((at, r.choice([" ", "\n"]).join(w)))
            at += 1
    rows += [(at, ""), (at + 1, None), (at + 2, "  \n"), (at + 3, " ".join(base * 40))]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "PARTS", 3)
    for options in ({}, {"cap": 8, "block": 4, "bits": 2, "tables": 4}, {"cap": 1, "block": 4, "bits": 1, "tables": 4}):
        got = near_duplicates(df, **options).collect()
        assert {r.doc_id: r.class_id for r in got} == want, options
        assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(rows)


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (None, None), (8, None), (9, None)]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in got) == sorted([(-1, 3, False), (3, 3, True), (3, 3, True), (-1, -1, True), (-1, -1, True), (8, 8, True), (9, 9, True)])
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_is_the_sign_of_sums():
    r = np.random.default_rng(0)
    at = np.array([0, 3, 3, 900, 1200])
    found = r.integers(0, 2**63, 1200, dtype=np.uint64)
    got = np.unpackbits(simhash.signatures(found, at).view(np.uint8), axis=1, bitorder="little")
    salts = np.uint64(0xD1B54A32D192ED03) * np.arange(1, 5, dtype=np.uint64)
    for k in range(4):
        bits = np.unpackbits(simhash.mix(found[at[k] : at[k + 1], None] ^ salts).view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
        assert (got[k] == (2 * bits.sum(axis=0, dtype=int) > len(bits))).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_lone_pairs_at_the_limit(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows, pairs = [], 0
    for words, common in ([(9, None)] * 150 + [(19, None)] * 60 + [(184, 164)] * 90):
        one = [word() for _ in range(words)]
        # a word less, or another end: 4 of 5, 14 of 15 or 160 of 200 shingles are common
        two = one[:-1] if common is None else one[:common] + [word() for _ in range(words - common)]
        rows += [(2 * pairs, " ".join(one), "x"), (2 * pairs + 1, " ".join(two), "x")]
        pairs += 1
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"tables": 1, "distance": 0}):
        got = {x.doc_id: x.class_id for x in near_duplicates(df, **options).collect()}
        assert [k for k in range(pairs) if got[2 * k + 1] != 2 * k] == []
        assert all(got[2 * k] == 2 * k for k in range(pairs))


def test_near_copies_that_share_an_id(spark):
    import corpus_pipeline

    base = " ".join(f"w{k}" for k in range(100))
    for ids in ((5, 5, 9), (None, None, None), (None, 5, 5)):
        rows = [(i, f"{base} end{k}", "x") for k, i in enumerate(ids)]
        df = spark.createDataFrame([*rows, rows[1]], SCHEMA)
        got = near_duplicates(df).filter("kept").collect()
        least = min((i for i in ids if i is not None), default=None)
        assert len({(r.doc_id, r.text_key) for r in got}) == 1 and got[0].doc_id == got[0].class_id == least
        left = corpus_pipeline.near_duplicate(spark, df, "").collect()
        assert len(left) == 1 and left[0].doc_id == least


def test_hot_groups_are_split_without_losing_links(spark, monkeypatch):
    """A third of all texts are near copies of one; sampling alone, in parts, finds their class."""
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    monkeypatch.setattr(simhash, "PARTS", 4)
    r = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(200):
        words = list(base)
        words[r.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words), "c"))
    rows += [(1000 + k, " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(60)), "c") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.class_id for x in near_duplicates(df, cap=2).collect()}
    assert got == {i: 0 if i < 200 else i for i, _, _ in rows}


def test_sampled_bits_follow_the_corpus():
    assert [simhash.sampled_bits(n) for n in (0, 1, 10**7, 10**7 + 1, 2 * 10**7 + 1, 10**10)] == [14, 14, 14, 15, 16, 24]


def test_join_of_classes(spark):
    """Keys that hold much of the data, and rows without a key, are spread; each row comes out once."""
    from pyspark.sql import functions as F

    from tidemark.llm.graph import join_classes

    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else None if i % 3 == 1 else i) for i in range(300)], "id long, k long")
    classes = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("most"))
    for heavy in (1e-4, 0.1, 1.0):
        got = join_classes(rows, classes.filter("k <> 8"), "k", heavy, 4).collect()
        assert sorted((x.id, x.k, x.most) for x in got) == [(i, *((7, 297) if i % 3 == 0 else (None, None) if i % 3 == 1 else (i, None if i == 8 else i))) for i in range(300)]
    assert join_classes(rows.limit(0), classes.limit(0), "k").count() == 0


def test_no_shuffle_of_an_earlier_step_stays(spark):
    """Steps remove their shuffles while their plans are still referred to."""
    from pyspark.sql import functions as F

    from tidemark.llm.runtime import cut_lineage

    def shuffled():
        folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return sum(p.stat().st_size for p in folder.rglob("shuffle_*.data"))

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    plan = spark.range(200_000).select(F.expr("uuid()").alias("u")).repartition(3, "u")
    kept = cut_lineage(plan)
    for _ in range(50):
        if (left := shuffled() - before) < 1_000_000:
            break
        time.sleep(0.1)
    assert left < 1_000_000
    assert plan.count() == kept.count() == 200_000 and spark.conf.get(CLEANUP) == setting


def test_filter_before_a_join_loses_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import runtime

    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i - 2000) for i in range(4000)], "id long, k long")
    keys = spark.createDataFrame([(i - 2000,) for i in range(0, 4000, 7)] + [(None,)], "key long")
    want = {i for i in range(0, 4000, 7) if i % 10}
    for most in (1 << 27, 1 << 16):
        monkeypatch.setattr(runtime, "MOST_BITS", most)
        got = [r.id for r in runtime.among(rows, F.col("k"), keys, "key").collect()]
        assert want <= set(got) and len(got) == len(set(got)) < 1000
    assert runtime.among(rows, F.col("k"), keys.limit(0), "key").count() == 0


def test_common_shingles_follow_the_corpus(spark):
    """What one text in a few dozen has is known as common in a corpus of any size."""
    rows = [(k, " ".join([f"a{k}", f"b{k}", "one two three four five", f"c{k}"] if k % 8 == 0 else [f"d{k}"]), "x") for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(simhash.common_shingles(df, sample=4)[0]) == 1
