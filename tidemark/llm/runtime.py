"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import tidemark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this library and give checkpoints a home.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors
    share; it is used as it stands.  Only where it is unset and all of Spark
    runs in one process (tests) a folder of this machine is made.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(tidemark.__file__)))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


#: Spark removes the shuffle files of a query at its end where this is set when the query is planned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries planned in here remove their shuffle files at their end.

    Otherwise these stay for as long as anything refers to the plan and the
    driver doesn't collect its garbage, so that the disk holds the shuffles of
    all steps together.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written rows; the shuffle files that this took go."""
    prepare(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that the setting holds


#: Bits of a filter for each key, bits of the largest filter, and longs in a row of it.
FILTER_BITS, MOST_BITS, FILTER_LONGS = 16, 1 << 27, 1024


def among(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in column ``name`` of ``keys``; none that has such a key goes.

    A join that follows then shuffles few rows in vain.  The filter is a bitmap
    of hashes of at most ``MOST_BITS`` bits, broadcast; of more keys more rows
    pass.  Null keys go.
    """
    size = keys.count() * FILTER_BITS
    bits = min(MOST_BITS, max(64 * FILTER_LONGS, 1 << max(size - 1, 0).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    words = keys.filter(F.col(name).isNotNull()).select(place(F.col(name)).alias("p"))
    words = words.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("x"))
    lines = words.groupBy(F.shiftright("w", 10).alias("_line")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % FILTER_LONGS).cast("int").alias("k"), "x"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(FILTER_LONGS - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("long")))
    lines = lines.select("_line", filled.alias("_longs"))
    at = rows.withColumn("_at", F.when(key.isNotNull(), place(key))).withColumn("_line", F.shiftright("_at", 16))
    held = at.join(F.broadcast(lines), "_line")  # at most MOST_BITS / 65536 rows
    return held.filter(F.expr(f"(shiftright(_longs[cast(shiftright(_at, 6) % {FILTER_LONGS} as int)], cast(_at & 63 as int)) & 1) = 1")).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
