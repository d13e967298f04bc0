"""Packing by power-of-two decomposition.

A document's ids (then an end id) are cut into pieces whose lengths are powers
of two: whole pieces of the largest size first, then one piece for each bit of
the rest.  Each piece is a sequence of its own and pieces of equal length share
a bucket.  :func:`draw_batches` gathers the sequences of a bucket into batches
of about equal numbers of tokens.  So no sequence crosses documents and nothing
is padded.

Tokenizing and cutting are one pass without a shuffle.  A sequence's number is
its partition's number and its place there, so a task that runs again gives
the same numbers.  Null and empty texts consist of the end id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.runtime import prepare
from tidemark.llm.textvec import chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def decompose(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of each piece, in order."""
    bits = longest.bit_length() - 1
    whole = counts >> bits
    lengths = [np.repeat(longest, int(whole.sum()))]
    owner = [np.repeat(np.arange(len(counts)), whole)]
    for k in range(bits - 1, -1, -1):
        has = np.flatnonzero((counts >> k) & 1)
        owner.append(has)
        lengths.append(np.full(len(has), 1 << k))
    who, size = np.concatenate(owner), np.concatenate(lengths)
    order = np.argsort(who, kind="stable")
    who, size = who[order], size[order]
    ends = np.cumsum(size)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return who, ends - size - begin[who], size


def pack(docs: DataFrame, longest: int = 1024, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``bucket`` is the binary logarithm of its length.

    ``with_ids`` adds the column ``ids`` (array of int).  ``longest`` must be a
    power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    prepare(docs.sparkSession)
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                ids, first = enc.encode_batch(data, offsets)
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                counts = np.diff(first) + 1
                who, start, size = decompose(counts, longest)
                ends = np.cumsum(size)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                doc_id = batch.column(0).slice(a, b - a).take(pa.array(who))
                columns = [doc_id, start, size, np.array(crc, np.int64), counts[who], number + np.arange(len(who)), np.zeros(len(who), np.int64), np.log2(size).astype(np.int32)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                number += len(who)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def draw_batches(packed: DataFrame, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row per batch of sequences of one bucket: batch_id, bucket, n_sequences and sequence_ids,
    and ids (those of the sequences one after another) if ``packed`` has them.

    A batch is emitted when its bucket has ``batch_tokens`` tokens (at least one
    sequence), what is left at the end of a partition as smaller ones; every
    sequence is in one batch.  A task holds at most one open batch of each
    bucket, and nothing is shuffled: shuffle ``packed`` by a random number
    before, or the batches after, for another order.
    """
    prepare(packed.sparkSession)
    with_ids = "ids" in packed.columns
    schema = "batch_id long, bucket int, n_sequences int, sequence_ids array<long>" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        open_: dict[int, list[pa.RecordBatch]] = {}

        def draw(bucket: int, least: int) -> Iterator[pa.RecordBatch]:
            """Full batches of a bucket, of ``least`` sequences or more; the rest stays open."""
            nonlocal number
            held = pa.Table.from_batches(open_[bucket]).combine_chunks()
            room = max(1, batch_tokens >> bucket)
            while held.num_rows >= least:
                part, held = held.slice(0, room), held.slice(room)
                sequences = part.column(0).combine_chunks()
                columns = [pa.array([number]), pa.array([bucket], pa.int32()), pa.array([len(sequences)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(sequences)], pa.int32()), sequences)]
                if with_ids:
                    ids = part.column(2).combine_chunks().flatten()
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names)
            open_[bucket] = held.to_batches()

        for batch in batches:
            buckets = batch.column(1).to_numpy()
            for bucket in np.unique(buckets).tolist():
                open_.setdefault(bucket, []).append(batch.take(pa.array(np.flatnonzero(buckets == bucket))))
                room = max(1, batch_tokens >> bucket)
                if sum(b.num_rows for b in open_[bucket]) >= room:
                    yield from draw(bucket, room)
        for bucket in sorted(open_):
            if open_[bucket]:
                yield from draw(bucket, 1)

    names = [c.split()[0] for c in schema.split(", ")]
    return packed.select("sequence_id", "bucket", *["ids"] * with_ids).mapInArrow(run, schema)
