"""Writing tables: Parquet files in row order, snapshots, upserts and compaction, safe beside other writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ConflictError, MetadataError
from tidemark.lakehouse import Lakehouse
from tidemark.metadata import Delta, Segment, Snapshot
from tidemark.operators.scan import merge_files
from tidemark.schema import EVENT_TIME, KEY, TableSchema

#: So many rows one task sorts and writes where the number of files follows that of rows.
ROWS_A_FILE = 500_000


def _write(lake: Lakehouse, rows: DataFrame, schema: TableSchema, path: str) -> None:
    spark = lake.spark
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.to_struct_type()])
    old = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MILLIS")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", old)


def write_file(lake: Lakehouse, table: str, rows: DataFrame, schema: TableSchema, file: str) -> None:
    """One named Parquet file, in the order of ``rows``; instants in milliseconds."""
    part = f"_tmp_{uuid.uuid4().hex}"
    _write(lake, rows.coalesce(1), schema, lake.store.path(table, part))
    made = [n for n in lake.store.names(table, part) if n.endswith(".parquet")]
    if len(made) != 1:
        raise MetadataError(f"expected one file, found {len(made)}")
    lake.store.move((table, part, made[0]), (table, file))
    lake.store.remove(table, part)


def files_for(rows: int) -> int:
    """So many files that each has about ``ROWS_A_FILE`` rows at most, if no key has more."""
    return max(1, -(-rows // ROWS_A_FILE))


def write_parts(lake: Lakehouse, table: str, rows: DataFrame, schema: TableSchema, file: str, order: Sequence[Column], parts: int = 1) -> None:
    """One entry of a snapshot: a named Parquet file or, of several parts, a folder of that name.

    Each part has its keys to itself, its rows in ``order``, and is made by a task of its own.
    """
    if parts <= 1:
        write_file(lake, table, rows.orderBy(*order), schema, file)
        return
    part = f"_tmp_{uuid.uuid4().hex}"
    _write(lake, rows.repartition(parts, KEY).sortWithinPartitions(*order), schema, lake.store.path(table, part))
    lake.store.move((table, part), (table, file))


def write_files(lake: Lakehouse, table: str, rows: DataFrame, schema: TableSchema, stem: str, files: int = 1) -> list[str]:
    """``rows`` as so many Parquet files of different keys, each latest first, made by as many tasks.

    All rows of a key are in one file, so the files' order among each other
    doesn't matter.  Returns their names; without rows there is one empty file.
    """
    if files <= 1:
        write_file(lake, table, latest_first(rows), schema, f"{stem}.parquet")
        return [f"{stem}.parquet"]
    part = f"_tmp_{uuid.uuid4().hex}"
    spread = rows.repartition(files, KEY).sortWithinPartitions(*latest())
    _write(lake, spread, schema, lake.store.path(table, part))
    made = [n for n in lake.store.names(table, part) if n.endswith(".parquet")]
    names = [f"{stem}-{k}.parquet" for k in range(len(made))]
    for old, new in zip(made, names, strict=True):
        lake.store.move((table, part, old), (table, new))
    lake.store.remove(table, part)
    return names


def publish(lake: Lakehouse, table: str, snapshot: Snapshot, version: str) -> None:
    """Write a snapshot under a new version, then point to it.

    Of two writers of one version the second gets a :class:`ConflictError`.
    """
    if wrong := snapshot.validate():
        raise MetadataError("; ".join(wrong))
    if not lake.store.put_text(snapshot.to_json(), table, f"s{version}.json"):
        raise ConflictError(f"{table}: version {version} exists")
    lake.store.put_text(version, table, "version.txt", replace=True)


def following(version: str) -> str:
    """The version after another: the number at its end, if there is one, is raised."""
    head = version.rstrip("0123456789")
    return f"{head}{int(version[len(head):] or 0) + 1}"


def _commit(lake: Lakehouse, table: str, change: Callable[[Snapshot, str], Snapshot | None], attempts: int = 20) -> str:
    """Publish what ``change`` makes of the current snapshot (and the new version's name), again if another
    writer was first; the version that holds the change."""
    for _ in range(attempts):
        version = lake.table(table).version()
        new = following(version)
        if lake.store.exists(table, f"s{new}.json"):
            # written whole, but not pointed to yet, perhaps by a writer that is lost
            lake.store.put_text(new, table, "version.txt", replace=True)
            continue
        snapshot = change(lake.table(table).snapshot(version), new)
        if snapshot is None:
            return version
        try:
            publish(lake, table, snapshot, new)
            return new
        except ConflictError:
            continue
    raise ConflictError(f"{table}: {attempts} attempts failed")


def latest(*ties: str) -> list[Column]:
    """The order within a file that makes the first row of a key its latest."""
    return [F.col(EVENT_TIME).desc_nulls_last(), F.col(KEY), *map(F.col, ties)]


def latest_first(rows: DataFrame, *ties: str) -> DataFrame:
    return rows.orderBy(*latest(*ties))


def csv_rows(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """Rows of a CSV file without header or quoting, in file order; blank lines don't count.

    Instants need an offset.
    """
    fields = schema.to_struct_type().fields
    raw = ", ".join(f"`{f.name}` string" for f in fields)
    rows = spark.read.csv(path, schema=raw, header=False, quote="", mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def generate(lake: Lakehouse, table: str, csv: str, file: str) -> None:
    """CSV to Parquet with the table's schema; a folder of several CSV files, of different keys, becomes a folder of as many.

    One task takes one CSV file, so that the order of its rows is kept.
    """
    spark, schema = lake.spark, lake.get_schema(table)
    files = spark.read.text(csv).inputFiles()
    if len(files) <= 1:
        write_file(lake, table, csv_rows(spark, csv, schema), schema, file)
        return
    # no file is split, and a file that costs as much as a task may take has one to itself
    sizes = {"spark.sql.files.maxPartitionBytes": str(2**40), "spark.sql.files.openCostInBytes": str(2**40), "spark.sql.files.maxPartitionNum": None}
    old = {name: spark.conf.get(name, None) for name in sizes}
    part = f"_tmp_{uuid.uuid4().hex}"
    try:
        for name, value in sizes.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
        rows = csv_rows(spark, csv, schema)
        if (tasks := rows.rdd.getNumPartitions()) != len(files):
            raise MetadataError(f"{len(files)} CSV files, but {tasks} tasks")
        _write(lake, rows, schema, lake.store.path(table, part))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    lake.store.move((table, part), (table, file))


def create(lake: Lakehouse, table: str, schema: TableSchema, start: datetime, base: DataFrame | None = None, files: int = 1) -> None:
    names = write_files(lake, table, base, schema, "base", files) if base is not None else []
    publish(lake, table, Snapshot(schema, _roots("1", start, names, ())), "1")


def _roots(name: str, start: datetime, base: list[str], deltas: tuple[Delta, ...]) -> tuple[Segment, ...]:
    """A segment, or one for each of several base files; the deltas go before them all."""
    rest = [Segment(f"{name}.{k}", start, None, file) for k, file in enumerate(base[1:], 1)]
    return (Segment(name, start, None, base[0] if base else None, (), deltas), *rest)


def upsert(lake: Lakehouse, table: str, rows: DataFrame, start: datetime, end: datetime, files: int = 1, stem: str | None = None) -> str:
    """Add deltas to the first open segment, in a new snapshot; returns its version.

    Of deltas that start at the same instant the one that was added last wins.
    ``files``: as many tasks write as many files, of different keys.  ``stem``
    names them: if the current snapshot has deltas of that name already, nothing
    is done, so that a job may run again.
    """
    stem = stem or f"delta-{uuid.uuid4().hex[:12]}"
    own = (f"{stem}.parquet", f"{stem}-0.parquet")
    if {*own} & {*lake.table(table).snapshot().all_files()}:
        return lake.table(table).version()
    names = write_files(lake, table, rows, lake.get_schema(table), stem, files)

    def change(snapshot: Snapshot, _: str) -> Snapshot | None:
        if {*own} & {*snapshot.all_files()}:
            return None
        k = next((k for k, s in enumerate(snapshot.segments) if s.end is None), None)
        if k is None:
            raise MetadataError("no open segment")
        s = snapshot.segments[k]
        grown = Segment(s.id, s.start, s.end, s.file, s.segments, (*(Delta(f, start, end) for f in names), *s.delta))
        return Snapshot(snapshot.schema, (*snapshot.segments[:k], grown, *snapshot.segments[k + 1 :]))

    return _commit(lake, table, change)


def compact(lake: Lakehouse, table: str, at: datetime, files: int = 1) -> str:
    """Close the history before ``at`` and start segments whose bases are the state then.

    ``files``: as many tasks write as many base files, of different keys, each
    in a segment of its own.  Deltas that reach beyond ``at`` are kept in the
    new segment too, as are those that go before such a one.
    """
    def change(snapshot: Snapshot, version: str) -> Snapshot:
        state = merge_files(lake.spark, lake.table(table).folder, snapshot.data_files(at), snapshot.schema, at)
        base = write_files(lake, table, state, snapshot.schema, f"base-{uuid.uuid4().hex[:12]}", files)
        late: list[Delta] = []
        closed = []
        for s in snapshot.segments:
            if s.end is None:
                ordered = sorted(s.delta, key=lambda d: d.start, reverse=True)
                late += ordered[: max((k for k, d in enumerate(ordered, 1) if d.end > at), default=0)]
                # closed history keeps only the deltas that the new base doesn't replace
                s = Segment(s.id, s.start, at, s.file, s.segments, tuple(d for d in s.delta if d.start <= at))
            closed.append(s)
        ahead = _roots(version, at, base, tuple(Delta(d.file, max(d.start, at), max(d.end, at)) for d in late))
        return Snapshot(snapshot.schema, (*ahead, *closed))

    return _commit(lake, table, change)


def random_rows(spark: SparkSession, rows: int, start: datetime, end: datetime, keys: int, seed: int = 0) -> DataFrame:
    """Random updates with distinct (key, event_time), latest first."""
    span = int((end - start).total_seconds())
    made = spark.range(rows).select(F.floor(F.rand(seed) * keys).cast("string").alias(KEY), F.timestamp_seconds(F.lit(int(start.timestamp())) + F.floor(F.rand(seed + 1) * span)).alias(EVENT_TIME), F.concat(F.lit("value"), F.col("id").cast("string")).alias("value"))
    return latest_first(made.dropDuplicates([KEY, EVENT_TIME]))
