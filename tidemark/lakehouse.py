"""A root folder of event-time tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.asof import instant
from tidemark.metadata import Snapshot
from tidemark.operators.scan import merge_files
from tidemark.schema import TableSchema
from tidemark.sources.store import Store


class Table:
    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name

    def version(self) -> str:
        """The id of the current snapshot; white space around it doesn't count."""
        return self.store.read_text(self.name, "version.txt").strip()

    def snapshot(self, version: str | None = None) -> Snapshot:
        return Snapshot.from_json(self.store.read_text(self.name, f"s{self.version() if version is None else version}.json"))

    @property
    def folder(self) -> str:
        return self.store.path(self.name)


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def table(self, name: str) -> Table:
        return Table(self.store, name)

    def tables(self) -> list[str]:
        return [n for n in self.store.names() if self.store.exists(n, "version.txt")]

    def get_schema(self, name: str) -> TableSchema:
        return self.table(name).snapshot().schema

    def files(self, name: str, as_of: str | datetime | None = None, version: str | None = None) -> list[str]:
        return self.table(name).snapshot(version).data_files(instant(as_of))

    def scan(self, name: str, as_of: str | datetime | None = None, columns: Iterable[str] | None = None, version: str | None = None, strict: bool = True) -> DataFrame:
        """The state as of an instant of event time, or the current one.

        ``version`` reads another snapshot than the current.  The snapshot is
        read once, now.
        """
        table, at = self.table(name), instant(as_of)
        snapshot = table.snapshot(version)
        return merge_files(self.spark, table.folder, snapshot.data_files(at), snapshot.schema, at, columns, strict)
