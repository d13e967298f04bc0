import math
import random
from collections import defaultdict

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, mix_key string, passes int, rest string"


def corpus(spark, n=500, seed=2):
    r = random.Random(seed)
    rows = [(k, "w " * r.randint(0, 60), "en", "hot" if k % 10 else r.choice(["a", "b", None]), "mine", 7, "r") for k in range(n)]
    rows += [(None, None, None, "empty", None, None, None), (3, "w w", "en", "a", "mine", 7, "r"), (3, "w w", "en", "a", "mine", 7, "r"), (9, "w " * 20_000, "en", "hot", "mine", 7, "r")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def read(rows):
    size, total = defaultdict(int), defaultdict(int)
    for x in rows:
        size[x.source] += x.n_tokens
        total[x.source] += x.n_tokens * x.n_copies
    return size, total


@pytest.mark.parametrize("most", [mixing.MOST_SOURCES, 2])
def test_limit_of_repetition_holds_for_any_budget(spark, most):
    """``most`` = 2: the weights are found by aggregates and joined by shuffle."""
    rows, df = corpus(spark)
    for budget, limit in ((200_000, 4.0), (60_000, 3.0), (2_000, 4.0)):
        got = mixing.mix_sources(df, max_repeats=limit, budget=budget, most=most).collect()
        size, total = read(got)
        assert len(got) == len(rows)
        assert all(total[s] <= limit * size[s] for s in size)
        most_of_all = sum(math.floor(limit * n) for n in size.values())
        # documents are taken whole, so a source reads less than one document less than its budget
        assert sum(total.values()) <= min(budget, most_of_all) + len(size)
        longest = max(x.n_tokens for x in got)
        assert sum(total.values()) >= min(budget, most_of_all) - longest - 60 * len(size)


def test_either_way_gives_the_same(spark):
    _, df = corpus(spark)
    one = sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr)
    assert sorted(map(tuple, mixing.mix_sources(df, most=1).collect()), key=repr) == one


def test_copies_keep_all_columns_whatever_their_names(spark):
    rows, df = corpus(spark)
    want = {x.doc_id: x.n_copies for x in mixing.mix_sources(df).collect()}
    got = mixing.mixed(df).collect()
    assert mixing.mixed(df).columns == df.columns
    assert all(x.mix_key == "mine" and x.passes == 7 and x.rest == "r" for x in got if x.doc_id is not None)
    count = defaultdict(int)
    for x in got:
        count[x.doc_id] += 1
    assert all(count[i] == n for i, n in want.items() if i != 3 and i != 9 and i is not None) and count[None] == 1
    assert mixing.mixed(df.limit(0)).count() == mixing.mix_sources(df.limit(0)).count() == 0


def test_exponent_is_bisected():
    shares = [0.7, 0.2, 0.06, 0.04]
    assert mixing.entropy(shares, mixing.find_exponent(shares, 0.9, None)) == pytest.approx(0.9)
    e = mixing.find_exponent(shares, 1.0, 3.0)  # only the limit binds
    assert e == pytest.approx(1 - math.log(3) / math.log(0.7 / 0.04)) and (0.7 / 0.04) ** (1 - e) <= 3.0 + 1e-12
    for points in (1, 5, 31):
        low, high = mixing.bisect(lambda at: [x * x <= 2 for x in at], 0.0, 2.0, points)
        assert low * low <= 2 and high == pytest.approx(math.sqrt(2), abs=1e-12)


def test_end_of_the_budget_by_brute_force(spark):
    """Blocks in their order, and in the last block documents by their keys, as far as the budget goes."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    r = random.Random(6)
    rows = [(k, "w " * r.randint(0, 9), "en", "s", None, None, None) for k in range(300)]
    for budget in (1, 40, 700, 1700):
        got = {x.doc_id: x.n_copies for x in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), None, None, budget).collect()}
        size = {k: t.count("w") for k, t, *_ in rows}
        q, left = divmod(budget, sum(size.values()))
        key = {k: md5(f"1:{k}:{md5(t)}") for k, t, *_ in rows}
        used, extra, open_ = 0, set(), True
        blocks = defaultdict(list)
        for k in sorted(key, key=key.get):
            blocks[key[k][:3]].append(k)
        for b in sorted(blocks, key=lambda b: md5(f"1:{q}:=s:{b}")):
            for k in blocks[b]:
                open_ = open_ and used + size[k] <= left
                if open_:
                    used += size[k]
                    extra.add(k)
            if not open_:
                break
        assert got == {k: q + (k in extra) for k in key}, budget
