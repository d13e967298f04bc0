"""Snapshots: a forest of time-range segments, and which files a version reads.

The order of the files is their precedence.  Only the driver works here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from tidemark.asof import format_instant, parse_instant
from tidemark.errors import MetadataError, TidemarkError
from tidemark.schema import EVENT_TIME, KEY, TableSchema


@dataclass(frozen=True)
class Delta:
    file: str
    start: datetime
    end: datetime

    def is_before(self, at: datetime | None) -> bool:
        """The end isn't looked at: an ended delta still holds live rows."""
        return at is None or self.start <= at


@dataclass(frozen=True)
class Segment:
    id: str
    start: datetime
    end: datetime | None = None
    file: str | None = None
    segments: tuple[Segment, ...] = field(default_factory=tuple)
    delta: tuple[Delta, ...] = field(default_factory=tuple)

    def is_in_range(self, at: datetime | None) -> bool:
        """Current: open-ended.  Otherwise both ends are inclusive."""
        if at is None:
            return self.end is None
        return self.start <= at and (self.end is None or at <= self.end)

    def data_files(self, at: datetime | None) -> list[str]:
        """Children in range first, then own deltas from the latest start, then the base.

        Deltas don't depend on the segment's own range.
        """
        out = [f for child in self.segments if child.is_in_range(at) for f in child.data_files(at)]
        out += [d.file for d in sorted((d for d in self.delta if d.is_before(at)), key=lambda d: d.start, reverse=True)]
        if self.file is not None and self.is_in_range(at):
            out.append(self.file)
        return out


@dataclass(frozen=True)
class Snapshot:
    schema: TableSchema
    segments: tuple[Segment, ...] = field(default_factory=tuple)

    def data_files(self, at: datetime | None) -> list[str]:
        return [f for s in self.segments for f in s.data_files(at)]

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        try:
            value = json.loads(text)
            return cls(TableSchema.from_json(value["schema"]), tuple(_segment(s) for s in value["segments"]))
        except TidemarkError:
            raise
        except (ValueError, KeyError, TypeError) as e:
            raise MetadataError(f"bad snapshot: {e!r}") from e

    def to_json(self) -> str:
        return json.dumps({"schema": self.schema.to_json(), "segments": [_plain(s) for s in self.segments]}, indent=1)

    def all_files(self) -> list[str]:
        out: list[str] = []
        todo = list(self.segments)
        while todo:
            s = todo.pop()
            out += [s.file] * (s.file is not None) + [d.file for d in s.delta]
            todo += s.segments
        return out

    def validate(self) -> list[str]:
        """What is wrong: reserved or repeated names, ranges that end before they start or leave their parent."""
        names = [c.name for c in self.schema.columns]
        out = [f"reserved column name: {n}" for n in names if n in (KEY, EVENT_TIME)]
        out += [f"repeated column name: {n}" for n in sorted({n for n in names if names.count(n) > 1})]

        def walk(s: Segment, parent: Segment | None) -> None:
            if s.end is not None and s.end < s.start:
                out.append(f"segment {s.id} ends before it starts")
            if parent is not None and (s.start < parent.start or (parent.end is not None and (s.end is None or s.end > parent.end))):
                out.append(f"segment {s.id} leaves segment {parent.id}")
            for d in s.delta:
                if d.end < d.start:
                    out.append(f"delta {d.file} ends before it starts")
                if d.start < s.start:
                    out.append(f"delta {d.file} starts before segment {s.id}")
            for child in s.segments:
                walk(child, s)

        for s in self.segments:
            walk(s, None)
        return out


def _segment(value: dict) -> Segment:
    end = value.get("end")
    return Segment(
        str(value["id"]),
        parse_instant(value["start"]),
        None if end is None else parse_instant(end),
        value.get("file"),
        tuple(_segment(s) for s in value.get("segments") or ()),
        tuple(Delta(d["file"], parse_instant(d["start"]), parse_instant(d["end"])) for d in value.get("delta") or ()),
    )


def _plain(s: Segment) -> dict:
    out: dict = {"id": s.id, "start": format_instant(s.start)}
    if s.end is not None:
        out["end"] = format_instant(s.end)
    if s.file is not None:
        out["file"] = s.file
    if s.segments:
        out["segments"] = [_plain(c) for c in s.segments]
    if s.delta:
        out["delta"] = [{"file": d.file, "start": format_instant(d.start), "end": format_instant(d.end)} for d in s.delta]
    return out
