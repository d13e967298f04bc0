"""Merge-on-read: the first surviving row of each key, by file precedence and row position.

One lazy plan: the as-of filter and the columns reach the Parquet scan, and
``row_number() = 1`` becomes a group limit before the only shuffle, which is by
key.  Event times are never compared between rows.  Predicates on values stay
above the merge, so that no stale row comes back; Catalyst sees to that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.asof import micros
from tidemark.errors import MetadataError
from tidemark.schema import EVENT_TIME, KEY, TableSchema

RANK, ROW = "_tm_rank", "_tm_row"
#: Up to so many files the precedence is a CASE, beyond it a join with their list, which is broadcast up to so many names.
CASES, LISTED = 32, 100_000


def first_of_key(rows: DataFrame) -> DataFrame:
    """Rows (with RANK and ROW) that win their key."""
    order = Window.partitionBy(KEY).orderBy(RANK, ROW)
    return rows.withColumn("_tm_n", F.row_number().over(order)).filter("_tm_n = 1").drop("_tm_n")


def at_most(as_of: datetime | None) -> Column:
    return F.lit(True) if as_of is None else F.col(EVENT_TIME) <= F.timestamp_micros(F.lit(micros(as_of)))


def merge_files(spark: SparkSession, folder: str, files: Sequence[str], schema: TableSchema, as_of: datetime | None, projection: Iterable[str] | None = None, strict: bool = True) -> DataFrame:
    """Columns are bound by name; one that a file lacks is null.

    An entry of ``files`` may be a folder of Parquet files, each of which has its
    keys to itself; they have the precedence of the folder.
    """
    names = schema.select(projection, strict)
    read = schema.to_struct_type()
    once = list(dict.fromkeys(files))  # of repeated entries the first counts
    if not once:
        return spark.createDataFrame([], read).select(*names)
    rows = spark.read.schema(read).parquet(*[f"{folder}/{f}" for f in once])
    # the name in the metadata is percent-encoded
    encoded = [quote(f.rsplit("/", 1)[-1], safe="!$&'()*+,;=:@-._~") for f in once]
    leaves = rows.inputFiles()  # as _metadata.file_path has them; Spark has listed them already
    if len(leaves) != len(once) or not {leaf.rsplit("/", 1)[-1] for leaf in leaves} <= {*encoded}:
        return first_of_key(_ranked_parts(rows, folder, once, leaves).filter(at_most(as_of))).select(*names)
    rows = rows.select("*", F.col("_metadata.file_name" if len(set(encoded)) == len(once) else "_metadata.file_path").alias("_tm_file"), F.col("_metadata.row_index").alias(ROW))
    if len(set(encoded)) < len(once):
        # one name in several folders: the longest path that the file's ends with
        paths = [quote(f.lstrip("/"), safe="/!$&'()*+,;=:@-._~") for f in once]
        rank = F.lit(None).cast("int")
        for k, name in sorted(enumerate(paths), key=lambda x: len(x[1])):
            rank = F.when(F.endswith("_tm_file", F.lit("/" + name)), F.lit(k)).otherwise(rank)
        rows = rows.withColumn(RANK, rank)
    elif len(once) <= CASES:
        rank = F.lit(len(once) - 1)
        for k, name in reversed(list(enumerate(encoded[:-1]))):
            rank = F.when(F.col("_tm_file") == name, F.lit(k)).otherwise(rank)
        rows = rows.withColumn(RANK, rank)
    else:
        listed = spark.createDataFrame(list(zip(encoded, range(len(encoded)), strict=True)), f"_tm_file string, {RANK} int")
        # without the hint the rows may be moved to the few names
        rows = rows.join(F.broadcast(listed) if len(once) <= LISTED else listed, "_tm_file")
    return first_of_key(rows.filter(at_most(as_of))).select(*names)


def _ranked_parts(rows: DataFrame, folder: str, entries: Sequence[str], leaves: Sequence[str]) -> DataFrame:
    """Rows with RANK and ROW where some entries are folders: the rank of an entry goes for all files in it."""
    spark = rows.sparkSession
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    # paths without scheme and authority, of which the empty one is written in two ways
    paths = {fs.makeQualified(new(f"{folder}/{f}")).toUri().getRawPath(): k for k, f in enumerate(entries)}
    starts, found = {}, {}
    for leaf in leaves:
        before = re.match(r"([A-Za-z][\w+.-]*:)?(//[^/]*)?", leaf)
        path = leaf[before.end() :]
        entry = path
        while entry and entry not in paths:
            entry = entry.rpartition("/")[0]
        if not entry:
            raise MetadataError(f"{leaf} belongs to none of the files that were named")
        for head in {before[0]} if before[2] not in (None, "//") else {before[1] or "", f"{before[1] or ''}//"}:
            found[head + path] = starts[head + entry] = paths[entry]
    rows = rows.select("*", F.col("_metadata.file_path").alias("_tm_file"), F.col("_metadata.row_index").alias(ROW))
    if len(paths) <= CASES:
        rank = F.lit(None).cast("int")
        for start, k in sorted(starts.items(), key=lambda x: len(x[0])):
            rank = F.when((F.col("_tm_file") == start) | F.startswith("_tm_file", F.lit(start + "/")), F.lit(k)).otherwise(rank)
        return rows.withColumn(RANK, rank)
    listed = spark.createDataFrame(list(found.items()), f"_tm_file string, {RANK} int")
    return rows.join(F.broadcast(listed) if len(found) <= LISTED else listed, "_tm_file")


def merge_ordered(sources: Sequence[DataFrame], as_of: datetime | None) -> DataFrame:
    """The same merge over DataFrames with key, event_time and a column ``ROW``, in order of precedence."""
    rows = None
    for k, source in enumerate(sources):
        source = source.withColumn(RANK, F.lit(k))
        rows = source if rows is None else rows.unionByName(source)
    return first_of_key(rows.filter(at_most(as_of))).drop(RANK, ROW)
