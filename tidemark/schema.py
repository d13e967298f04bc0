"""Declared schemas: value columns in the snapshot, key and event_time before them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidemark.errors import SchemaError

KEY, EVENT_TIME = "key", "event_time"
_TYPES = {"String": T.StringType(), "Int": T.LongType(), "Boolean": T.BooleanType(), "DateTime": T.TimestampType()}
#: Not part of the format as first defined: kept apart, so strict readers can refuse them.
_EXTENSIONS = {"Double": T.DoubleType(), "Date": T.DateType()}


def spark_type(name: str) -> T.DataType:
    if name in _TYPES or name in _EXTENSIONS:
        return (_TYPES | _EXTENSIONS)[name]
    if m := re.fullmatch(r"Decimal\((\d+),\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    raise SchemaError(f"unknown column type: {name}")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    data_type: str
    nullable: bool = False

    @property
    def is_extension(self) -> bool:
        return self.data_type not in _TYPES


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)

    @classmethod
    def from_json(cls, value: dict) -> TableSchema:
        try:
            columns = tuple(ColumnDef(c["name"], c["data_type"], bool(c.get("nullable", False))) for c in value["columns"])
        except (KeyError, TypeError) as e:
            raise SchemaError(f"bad schema: {e}") from e
        for c in columns:
            spark_type(c.data_type)
        return cls(columns)

    def to_json(self) -> dict:
        return {"columns": [{"name": c.name, "data_type": c.data_type, "nullable": c.nullable} for c in self.columns]}

    @property
    def names(self) -> list[str]:
        return [KEY, EVENT_TIME, *(c.name for c in self.columns)]

    def to_struct_type(self, projection: Iterable[str] | None = None) -> T.StructType:
        """Fields in canonical order, whatever the projection's order."""
        fields = [T.StructField(KEY, T.StringType(), False), T.StructField(EVENT_TIME, T.TimestampType(), False)]
        fields += [T.StructField(c.name, spark_type(c.data_type), c.nullable) for c in self.columns]
        wanted = None if projection is None else set(projection)
        return T.StructType([f for f in fields if wanted is None or f.name in wanted])

    def select(self, projection: Iterable[str] | None, strict: bool = True) -> list[str]:
        """Names to return, in canonical order.  Unknown ones raise, unless not ``strict``."""
        if projection is None:
            return self.names
        wanted = set(projection)
        if strict and (unknown := wanted - set(self.names)):
            raise SchemaError(f"unknown columns: {sorted(unknown)}")
        return [n for n in self.names if n in wanted]
