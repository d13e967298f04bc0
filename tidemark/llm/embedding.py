"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Each vector is scaled to length one and rounded to int8 with its own scale; the
length of what rounding lost is kept.  By Cauchy-Schwarz the true cosine of two
vectors differs from the product of their int8 forms by at most
``e_x * (1 + e_y) + e_y``, so only pairs whose bound reaches the threshold are
computed again in double precision, and none is missed.

Equal vectors are one class before anything is compared.  The classes are cut
into blocks of about ``VALUES`` components; a task multiplies two blocks, tile
by tile, and returns counts per vector and a spanning forest of its links, never
the pairs.  Single-precision vectors travel as they are, not as doubles.  They
travel whole, as pairs that were to be computed again elsewhere could be as many
as a group of near copies has pairs.  The work is quadratic in the number of
different vectors, the memory of a task isn't.

A vector that is null, empty, zero, or holds null or non-finite components
links with nothing and is kept.  Vectors of different lengths aren't compared.
A null vec_id counts as a vector; a class's id is its smallest vec_id that
isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components, join_classes
from tidemark.llm.runtime import cut_lineage, prepare

TILE = 1024
#: Products of int8 values are exact in single precision up to this many components.
EXACT = 1000
#: Components that a block holds at most, and blocks into which small tables are cut to occupy more tasks.
VALUES, SPREAD = 1 << 22, 8
#: Different lengths of vectors up to which their list is broadcast.
LENGTHS = 10_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (as float32, for BLAS), scales, and an upper bound of each vector's error."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.float32), scale, error


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


def tile_links(one: tuple, two: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of both tiles that link, and how many pairs were computed again.

    A tile is (unit vectors in double, int8 values, scales, errors).
    """
    (u, q, s, e), (v, r, t, f) = one, two
    # s_i * t_j * q_i.r_j >= threshold - bound, over s_i: each row is compared with its own limits
    worst = e[:, None] * 0 + f.max() if len(f) else e
    limit = ((threshold - 1e-12) - (e + worst[:, 0] * (1 + e))) / s
    product = _product(q, r) * t[None, :].astype(np.float32)
    slack = 1e-5 * np.abs(limit) + 1e-5  # of the single precision factor
    i, j = np.nonzero(product >= (limit - slack)[:, None].astype(np.float32))
    if not len(i):
        return i, j, 0
    if len(i) > 0.05 * product.size:  # dense: products of the rows concerned
        rows, cols = np.unique(i), np.unique(j)
        x, y = np.nonzero(u[rows] @ v[cols].T >= threshold)
        return rows[x], cols[y], len(rows) * len(cols)
    hit = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        hit[k : k + 65536] = np.einsum("ij,ij->i", u[i[k : k + 65536]], v[j[k : k + 65536]]) >= threshold
    return i[hit], j[hit], len(i)


def _compare(node: np.ndarray, times: np.ndarray, role: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the other vectors it links with, and the smallest row of its linked part.

    ``role``: two blocks (0 and 1) are compared with each other, one block with itself.
    """
    n = len(node)
    values = values.astype(np.float64)
    unit = values / np.linalg.norm(values / np.abs(values).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(values).max(axis=1, keepdims=True)
    q, s, e = quantise(unit)
    count = np.zeros(n, np.int64)
    up = np.arange(n)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    cross = bool((role == 1).any())
    left = np.flatnonzero(role == 0)
    right = np.flatnonzero(role == 1) if cross else left
    for a in range(0, len(left), TILE):
        rows = left[a : a + TILE]
        for b in range(0 if cross else a, len(right), TILE):
            cols = right[b : b + TILE]
            i, j, _ = tile_links((unit[rows], q[rows], s[rows], e[rows]), (unit[cols], q[cols], s[cols], e[cols]), threshold)
            x, y = rows[i], cols[j]
            if not cross and a == b:
                x, y = x[i < j], y[i < j]
            if not len(x):
                continue
            count += np.bincount(x, times[y], n).astype(np.int64) + np.bincount(y, times[x], n).astype(np.int64)
            # one link from each row to the first it meets, then the others' between the parts
            while len(x):
                _, first = np.unique(x, return_index=True)
                for k in first.tolist():
                    c, d = root(int(x[k])), root(int(y[k]))
                    if c != d:
                        up[max(c, d)] = min(c, d)
                top = np.arange(n)
                flat = up.copy()
                while (flat != (deeper := flat[flat])).any():
                    flat = deeper
                top = flat
                up[:] = top
                apart = top[x] != top[y]
                x, y = x[apart], y[apart]
    return count, up


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    ``block``: vectors of a block, if not as many as ``VALUES`` allows.
    """
    prepare(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    # a 64-bit hash stands for the vector; -0.0 is 0.0
    rows = rows.withColumn("node", F.when(usable, F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"), F.first("v").cast(kind).alias("v"))
    classes = cut_lineage(classes.withColumn("dim", F.size("v")))
    n = F.count("*")
    many = F.ceil(n / block) if block else F.greatest(F.ceil(n * F.col("dim") / VALUES), F.least(F.ceil(n / (2 * TILE)), F.lit(SPREAD)))
    sizes = cut_lineage(classes.groupBy("dim").agg(many.cast("int").alias("n_blocks"), n.alias("times")))
    sized = classes.withColumnRenamed("times", "copies")
    sized = sized.join(F.broadcast(sizes.drop("times")), "dim") if sizes.count() <= LENGTHS else join_classes(sized, sizes, "dim")
    placed = sized.withColumnRenamed("copies", "times").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    tasks = placed.select("dim", "block", "node", "times", "v", other)
    tasks = tasks.select("dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("role"), "node", "times", "v")
    tasks = tasks.repartition("dim", "low", "high").sortWithinPartitions("dim", "low", "high", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            role, node, times = (np.concatenate([h[k] for h in held]) for k in range(3))
            values = np.concatenate([h[3] for h in held])
            # a block with itself has one role only
            count, up = _compare(node, times, role - role.min(), values, threshold)
            some = np.flatnonzero(count > 0)
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[up[some]])], ["a", "links", "b"])

        for batch in batches:
            dim, low, high, role, node, times = (batch.column(k).to_numpy() for k in range(6))
            flat = batch.column(6).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(dim)])
            change = np.flatnonzero((dim[1:] != dim[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            bounds = [0, *change.tolist(), len(dim)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                here = (dim[a], low[a], high[a])
                if key is not None and here != key:
                    yield flush()
                    held.clear()
                key = here
                held.append((role[a:b], node[a:b], times[a:b], flat[at[a] : at[b]].reshape(b - a, -1)))
        if held:
            yield flush()

    found = cut_lineage(tasks.mapInArrow(run, "a long, links long, b long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(found.select("a", "b"))
    of_node = classes.select("node", "first_id", "times").join(links, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = cut_lineage(of_node.join(least, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "times"))
    out = join_classes(rows.select("vec_id", "node"), of_node, "node")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
