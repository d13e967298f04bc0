"""Labelled documents: all of them, or bounded samples and models fitted by one task.

What follows holds for the samples.

The bound (``size`` rows of labels, chosen by a hash of the id) is a parameter
of each classifier; scoring covers all rows.  The sample's ids are few enough
to broadcast, so the documents are read once and never shuffled for training.
Rows are first cut by a hash limit that an approximate count gives, so that
what one task sorts doesn't grow with the data.  The fitting task reads at most
``most_bytes`` of text of the sample, in its order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import among, cut_lineage, prepare


def smallest_hashes(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows whose 64-bit hash ``name`` lies below a limit: all that have one of the ``size`` smallest, and some more.

    The limit follows from the approximate count of distinct hashes (2 % off
    at most times), with room for a fifth more.
    """
    many = rows.agg(F.approx_count_distinct(name, 0.02)).first()[0]
    room = size + size // 5 + 100
    return rows if many <= room else rows.filter(F.col(name) <= int(room / many * 2**64) - 2**63)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int) -> DataFrame:
    """doc_id, label (0 or 1), lang and text of at most ``size`` labelled documents.

    ``learn`` says of a row of ``labels`` whether it may be learnt from.  Null
    and repeated labels: an id has its largest label that isn't null; of
    repeated ids the largest text counts.
    """
    chosen = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    chosen = smallest_hashes(chosen.withColumn("h", F.xxhash64("doc_id")), "h", size).groupBy("doc_id", "h").agg((F.max("label") > 0).cast("int").alias("label"))
    chosen = chosen.orderBy("h", "doc_id").limit(size).drop("h")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows
    return rows.groupBy("doc_id", "label").agg(F.max(F.struct("text", "lang")).alias("x")).select("doc_id", "label", "x.lang", "x.text")


def all_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> tuple[DataFrame, int]:
    """What :func:`labelled` gives, of all labelled documents, and how many ids have labels."""
    chosen = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = cut_lineage(chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label")))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    rows = among(rows, F.col("doc_id"), chosen, "doc_id").join(chosen, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.max(F.struct("text", "lang")).alias("x")).select("doc_id", "label", "x.lang", "x.text"), chosen.count()


def fit(sample: DataFrame, train: Callable[[Iterator[pa.RecordBatch]], bytes], most_bytes: int = 1 << 28) -> bytes:
    """The model that ``train`` makes of the bounded sample, in one task, in a fixed order."""
    prepare(sample.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most_bytes
        for batch in batches:
            size = [len(t.as_buffer() or b"") for t in batch.column(3)]
            fits = int(np.searchsorted(np.cumsum(size), left, "right"))
            left -= sum(size[:fits])
            yield batch.slice(0, fits)
            if fits < batch.num_rows:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([train(first(batches))], pa.binary())], ["model"])

    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = rows.mapInArrow(run, "model binary").first()
    return train(iter(())) if made is None else bytes(made[0])  # no task runs where no row is labelled
