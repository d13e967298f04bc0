"""Connected components of an edge table, by alternating star contractions.

Edges that happen to lie in one partition are contracted there first, in chunks
of bounded size.  Then large-star links each node's larger neighbours to its smallest, small-star its
smaller ones; after O(log^2 n) rounds every edge points at its component's
smallest node.  Minima are pre-aggregated before they are shuffled and joined
back, so a node with very many edges is no single task's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut_lineage, prepare


#: Keys that hold more than this part of all rows are split, so they are at most as many as its inverse.
HEAVY, SALTS = 1e-4, 64


def join_classes(rows: DataFrame, classes: DataFrame, key: str, heavy: float = HEAVY, salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` with ``classes`` (one row for each ``key``; ``times``: rows that have it) on ``key``.

    Rows of a key that holds much of the data are spread over ``salts`` copies
    of its class, and rows without a key, which match nothing, over all tasks.
    ``classes`` should be written down, as it is read thrice.  ``times`` isn't
    returned.
    """
    total = classes.agg(F.sum("times")).first()[0] or 0
    hot = classes.filter(F.col("times") > heavy * total).select(key, F.lit(salts).alias("_salts"))
    place = F.monotonically_increasing_id()
    left = rows.join(F.broadcast(hot), key, "left")  # at most 1 / heavy keys
    left = left.withColumns({"_none": F.col(key).isNull(), "_key": F.coalesce(key, F.xxhash64(place)), "_salt": F.when(F.col("_salts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(place, F.lit(salts).cast("long")))})
    right = classes.withColumn("_salt", F.explode(F.when(F.col("times") > heavy * total, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    right = right.withColumn("_none", F.lit(False)).withColumnRenamed(key, "_key").drop("times")
    return left.join(right, ["_none", "_key", "_salt"], "left").drop("_none", "_key", "_salt", "_salts")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (a, b): the neighbours b that node a looks at."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(least, "a")
    if large:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.filter("a <> m").select("a", F.col("m").alias("b"))
    return linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


CHUNK = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edges as (node, smallest node of its part)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def flush() -> pa.RecordBatch:
        nodes = [x for x in up if up[x] != x]
        roots = [root(x) for x in nodes]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > CHUNK:
            yield flush()
    yield flush()


def _settled(now: DataFrame) -> bool:
    """Whether every node has one edge, and it leads to a node without one."""
    ends = now.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    state = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return state.filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another one.

    ``edges`` has the long columns ``a`` and ``b``; direction, repetition and
    loops don't matter, rows with a null end are ignored.  The component is its
    smallest node.
    """
    prepare(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = cut_lineage(now.mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(most_rounds):
        if _settled(now):
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True).filter("a <> b").distinct()
        # large-star may name a smaller node first
        ordered = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = cut_lineage(_star(ordered, False).filter("a <> b").distinct())
    raise RuntimeError("components did not settle")
