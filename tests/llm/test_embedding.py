import numpy as np

from tidemark.llm import embedding
from tidemark.llm.embedding import near_vectors, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, threshold):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + r.normal(size=8) * 0.13 * (1 + k % 3)).tolist()) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(5)] + [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, [1.0, 0.0]), (307, [2.0, 0.01]), (308, [1e-30] * 8), (309, [3e-30] * 8), (310, [-0.0] * 7 + [1.0]), (311, [0.0] * 7 + [1.0])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    want = brute(rows, 0.95)
    for options in ({}, {"block": 8192}, {"block": 20}, "lengths", "double"):
        if options == "lengths":
            monkeypatch.setattr(embedding, "LENGTHS", 1)
            monkeypatch.setattr(embedding, "VALUES", 200)
        data = df.withColumn("embedding", df.embedding.cast("array<double>")) if options == "double" else df
        got = near_vectors(data, **(options if isinstance(options, dict) else {})).collect()
        assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == want
        assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert near_vectors(df.limit(0)).count() == 0


def test_bound_holds():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = quantise(x)
    rough = (q @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(rough - x @ x.T) <= e[:, None] * (1 + e[None, :]) + e[None, :]).all()
