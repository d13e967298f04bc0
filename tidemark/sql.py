"""SQL with a version clause per table, rewritten to views before Spark parses it.

``t AT('<instant>')``, ``t AT(TIMESTAMP => '<instant>')`` and
``t FOR SYSTEM_TIME AS OF '<instant>'`` name the state of ``t`` at an instant of
event time.  A clause of another form raises.  Names that aren't tables of the
lakehouse are left to Spark, as are those that a WITH clause defines, wherever
it is in force.  A temporary view of the user's isn't overwritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.asof import format_instant, micros, parse_instant
from tidemark.errors import VersionClauseError
from tidemark.lakehouse import Lakehouse
from tidemark.operators.scan import merge_files

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|''|\\.)*')|(?P<name>`(?:[^`]|``)+`|"(?:[^"]|"")+"|[^\W\d]\w*)|(?P<sign>=>|.)""", re.S)
#: Words that follow a table but aren't an alias of it.
_NOT_ALIAS = set("where group order having limit offset union intersect except minus on using join inner left right full cross natural semi anti lateral window qualify sort cluster distribute tablesample pivot unpivot for set values select from when then and or with as by".split())


@dataclass(frozen=True)
class VersionedTable:
    name: str
    view: str
    as_of: datetime | None


@dataclass
class _Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else self.text


def _tokens(sql: str) -> list[_Token]:
    return [_Token(m.lastgroup or "", m.group()) for m in _TOKEN.finditer(sql)]


def _plain(name: str) -> str:
    return name[1:-1].replace(name[0] * 2, name[0]) if name[0] in "`\"" else name


def view_name(name: str, as_of: datetime | None) -> str:
    """``t__<ms>``; microseconds, marked, where milliseconds don't hold the instant."""
    if as_of is None:
        return f"{name}__current"
    us = micros(as_of)
    return f"{name}__{us // 1000}" if us % 1000 == 0 else f"{name}__{us}us"


def _defined(at, n: int) -> list[tuple[str, int, int]]:  # noqa: ANN001
    """Names that WITH clauses define among ``n`` tokens, each with the range of tokens where it is in force.

    A name holds after its own query (with RECURSIVE in it too), to the end of
    the query that the clause belongs to.
    """
    close, open_ = {}, []
    for i in range(n):
        if at(i).text == "(":
            open_.append(i)
        elif at(i).text == ")" and open_:
            close[open_.pop()] = i
    inside = [n] * (n + 1)  # the end of the bracket that holds each token
    for a, b in sorted(close.items()):
        inside[a + 1 : b] = [b] * (b - a - 1)
    out = []
    for i in range(n):
        if at(i).kind != "name" or at(i).text.lower() != "with":
            continue
        recursive = at(i + 1).text.lower() == "recursive" and at(i + 2).kind == "name"
        k = i + 1 + recursive
        while at(k).kind == "name":
            after = close.get(k + 1, n) + 1 if at(k + 1).text == "(" else k + 1
            if at(after).text.lower() != "as" or at(after + 1).text != "(" or after + 1 not in close:
                break
            end = close[after + 1]
            out.append((_plain(at(k).text).lower(), after + 1 if recursive else end, inside[i]))
            if at(end + 1).text != ",":
                break
            k = end + 2
    return out


def rewrite(sql: str, is_table) -> tuple[str, list[VersionedTable]]:  # noqa: ANN001 - a predicate on names
    """The statement for Spark, and the tables that it reads.

    Tables are found in FROM and JOIN, and after commas there; ``is_table``
    tells lakehouse tables from other names.
    """
    tokens = _tokens(sql)
    solid = [k for k, t in enumerate(tokens) if t.kind != "space"]
    refs: list[VersionedTable] = []
    out = [t.text for t in tokens]
    depth_from: list[bool] = [False]  # for each open bracket, whether a FROM list is being read

    def at(i: int) -> _Token:
        return tokens[solid[i]] if 0 <= i < len(solid) else _Token("", "")

    defined = _defined(at, len(solid))
    i = 0
    expecting = False
    while i < len(solid):
        t = at(i)
        if t.text.lower() == "table" and at(i + 1).kind == "name" and at(i - 1).word in ("", "(", ";", "union", "all", "distinct", "except", "intersect", "minus", "as", "explain"):
            out[solid[i]] = "SELECT * FROM"  # TABLE t
            expecting = True
            i += 1
            continue
        if t.text == "(":
            # an opening bracket within a FROM list may hold a join, or a query
            depth_from.append(expecting)
            i += 1
            continue
        if t.text == ")":
            if len(depth_from) > 1:
                depth_from.pop()
            expecting = False
            i += 1
            continue
        if t.word in ("from", "join") and t.kind == "name" and t.text[0] not in "`\"":
            before = at(i - 1).word
            # IS DISTINCT FROM, EXTRACT(x FROM y), TRIM(x FROM y)
            function = at(i - 2).text == "(" and at(i - 3).word in ("extract", "trim", "substring", "overlay") or at(i - 3).text == "(" and at(i - 4).word == "trim"
            expecting = not (t.word == "from" and (before == "distinct" and at(i - 2).word in ("is", "not") or function))
            if expecting:
                depth_from[-1] = True
            i += 1
            continue
        if t.text == "," and depth_from[-1]:
            expecting = True
            i += 1
            continue
        if expecting and t.kind == "name" and not (t.word in ("lateral", "select", "values", "unnest") and t.text[0] not in "`\""):
            expecting = False
            last = i
            while at(last + 1).text == "." and at(last + 2).kind == "name":
                last += 2
            name = _plain(at(last).text)
            after = last + 1
            as_of, end = _clause(at, after, name)
            if end == after and at(after).text == "(":  # a table function
                i = after
                continue
            if (last == i and any(n == name.lower() and a < i < b for n, a, b in defined)) or not is_table(name):
                if end > after:
                    raise VersionClauseError(f"{name} isn't a table of the lakehouse")
                i = after
                continue
            view = view_name(name, as_of)
            refs.append(VersionedTable(name, view, as_of))
            follows = at(end)
            aliased = follows.word == "as" or (follows.kind == "name" and (follows.text[0] in "`\"" or follows.word not in _NOT_ALIAS))
            for k in range(solid[i], solid[end - 1] + 1):
                out[k] = ""
            out[solid[i]] = f"`{view}`" + ("" if aliased else f" AS `{name}`")
            i = end
            continue
        if t.kind == "name" and t.word in ("where", "group", "order", "having", "limit", "select", "union", "intersect", "except", "window", "on", "using"):
            expecting = False
            depth_from[-1] = depth_from[-1] and t.word in ("on", "using")
        elif t.kind != "name" or t.word != "lateral":
            expecting = expecting and t.text == "("
        i += 1
    return "".join(out), list(dict.fromkeys(refs))


def _clause(at, k: int, name: str) -> tuple[datetime | None, int]:  # noqa: ANN001
    """The instant of the version clause at token k, and the token after it."""
    if at(k).word == "for" and at(k + 1).word in ("system_time", "timestamp", "version", "system_version"):
        if at(k + 1).word != "system_time" or at(k + 2).word != "as" or at(k + 3).word != "of" or at(k + 4).kind != "text":
            raise VersionClauseError(f"{name}: only FOR SYSTEM_TIME AS OF '<instant>' is supported")
        return parse_instant(at(k + 4).text[1:-1]), k + 5
    if at(k).kind == "name" and at(k).word in ("at", "before") and at(k + 1).text == "(":
        if at(k).word == "at" and at(k + 2).kind == "text" and at(k + 3).text == ")":
            return parse_instant(at(k + 2).text[1:-1]), k + 4
        if at(k).word == "at" and at(k + 2).word == "timestamp" and at(k + 3).text == "=>" and at(k + 4).kind == "text" and at(k + 5).text == ")":
            return parse_instant(at(k + 4).text[1:-1]), k + 6
        # AT (a, b) with names is an alias with column names, which Spark takes
        if at(k).word == "at" and at(k + 2).kind == "name" and at(k + 3).text in (",", ")"):
            return None, k
        raise VersionClauseError(f"{name}: no valid timestamp found in {at(k).text}(...)")
    return None, k


#: Views made here, by session.
_views: set[tuple[str, str]] = set()


class Context:
    """SQL over a lakehouse.  Each statement reads one snapshot of each table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.lakehouse = spark, Lakehouse(spark, root)

    def sql(self, statement: str) -> DataFrame:
        known: dict[str, bool] = {}

        def is_table(name: str) -> bool:
            if name not in known:
                known[name] = self.lakehouse.store.exists(name, "version.txt")
            return known[name]

        text, refs = rewrite(statement, is_table)
        pinned = {name: self.lakehouse.table(name).snapshot() for name in {r.name for r in refs}}
        for r in refs:
            own = (f"{self.spark.sparkContext.applicationId}/{self.spark._jsparkSession.sessionUUID()}", r.view)
            if own not in _views and self.spark.catalog.tableExists(r.view):
                raise VersionClauseError(f"{r.view} is a view or table already; drop it, or rename the table {r.name}")
            _views.add(own)
            files = pinned[r.name].data_files(r.as_of)
            merge_files(self.spark, self.lakehouse.table(r.name).folder, files, pinned[r.name].schema, r.as_of).createOrReplaceTempView(f"`{r.view}`")
        return self.spark.sql(text)

    def files(self, statement: str) -> DataFrame:
        """table_name, as_of, rank (of precedence), file and pruned, for each file of each version that the statement names."""
        _, refs = rewrite(statement, lambda name: self.lakehouse.store.exists(name, "version.txt"))
        rows = []
        for r in refs:
            snapshot = self.lakehouse.table(r.name).snapshot()
            read = list(dict.fromkeys(snapshot.data_files(r.as_of)))
            at = None if r.as_of is None else format_instant(r.as_of)
            rows += [(r.name, at, k, f, False) for k, f in enumerate(read)] + [(r.name, at, None, f, True) for f in sorted(set(snapshot.all_files()) - set(read))]
        return self.spark.createDataFrame(rows, "table_name string, as_of string, rank int, file string, pruned boolean")
