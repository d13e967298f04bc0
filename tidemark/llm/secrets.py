"""Secret scan with linked multipart credentials, as DataFrame expressions only.

Base spans are assignments of passwords and tokens, access identifiers and long
runs of hexadecimal digits.  Weak candidates are parts of a credential that say
nothing alone: a client or user name (``client``), a mixed value of 20 or more
signs (``value``) and an address (``endpoint``).  Each part has a scope, the
text up to ``SCOPE`` characters before and after it.  A weak part is reported
only where its scope meets that of complementary parts: an identifier (access
or client) needs a secret (assignment, hex or value), a value an identifier,
and an endpoint both, all within its scope.

The interval join of the parts of a text is a sweep over its sorted parts, once
in each direction, that carries the nearest identifier and the nearest secret,
so no pair is ever made.  All of it happens within the row: no row and no text
is shuffled.  Time is linear in the text, but for sorting its parts.

Matches of a pattern are found without positions and the text between them with
``split``; lengths of both, summed, give the positions in code points.  A null
text counts as empty.  Every row gives one row, repeated rows and ids too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200
MARK = "[SECRET]"
KINDS = ("assign", "access", "hex", "client", "value", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE_OF = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: None of them repeats a group, which would take the stack's depth of the text's length, and none
#: can be tried at every place of a long run, which would take the square of it.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    "client": r"""(?i:client_id|client|user|username|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "value": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"https?://[A-Za-z0-9.-]++(?::[0-9]+)?|(?<![a-z0-9.-])(?=[a-z0-9-]++\.[a-z0-9-])[a-z0-9.-]++:[0-9]{2,5}",
}
#: Words of which a text must hold one before its pattern is tried; those of ``assign`` and ``client`` in lower case.
NEEDED = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "client": ("client", "user", "login", "account"), "endpoint": ("://",)}
PART = "struct<start:long,kind:int,end:long>"
SPAN = f"array<{PART}>"
#: Array elements that are gathered before they are appended to the rest.
BLOCK = 64
#: Characters of a text that are looked at for one gap between spans.
CHUNK = 1024


def running(items: Column, state: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """What ``emit(state, item)`` gives for each item, ``step(state, item)`` being the next state.

    ``kind`` is the type of what is emitted.  An array can only grow by being
    copied, so blocks are gathered first, then an array of blocks.  ``items``
    must be a column, not an expression, as each block reads it.
    """
    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["last"]["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.struct(F.aggregate(part, start, one).alias("last"), F.concat(acc["out"], F.array(acc["last"]["out"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    start = F.struct(F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    done = F.aggregate(blocks, start, block, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["last"]["out"]))))
    return F.when(F.size(items) > 0, done).otherwise(F.array().cast(f"array<{kind}>"))


def _possible(text: Column, low: Column, kind: str) -> Column:
    """A cheap condition that holds wherever the kind's pattern may match."""
    out = F.lit(kind == "hex")
    for word in NEEDED.get(kind, ()):
        out = out | F.contains(low if kind in ("assign", "client") else text, F.lit(word))
    if kind == "endpoint":
        out = out | text.rlike(r":[0-9]{2}")
    return text.rlike("[0-9]") if kind == "value" else out


LENGTHS = "array<struct<kind:int,gap:long,hit:long,keep:boolean>>"


def _lengths(text: Column, low: Column, kind: str) -> Column:
    """Matches of the kind's pattern, leftmost and non-overlapping: lengths of what is before each, and of itself."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    both = F.filter(F.arrays_zip(found.alias("hit"), F.split(text, pattern, -1).alias("gap")), lambda z: z["hit"].isNotNull())

    def of(z: Column) -> Column:
        # short assignments count for the positions and are dropped afterwards
        keep = F.length(z["hit"]) - F.length(F.regexp_extract(z["hit"], VALUE_OF, 0)) >= 12 if kind == "assign" else F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(z["gap"]).cast("long").alias("gap"), F.length(z["hit"]).cast("long").alias("hit"), keep.alias("keep"))

    return F.when(_possible(text, low, kind) & text.rlike(pattern), F.transform(both, of).cast(LENGTHS)).otherwise(F.array().cast(LENGTHS))


def _located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (with a ``_`` before), text and parts: all matches of all kinds, by start and kind."""
    keep = [f"_{c}" for c in columns] + ["text"]
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in columns], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(*keep, F.lower("text").alias("low"))
    rows = rows.select(*keep, F.flatten(F.array(*[_lengths(F.col("text"), F.col("low"), k) for k in KINDS])).alias("lengths"))

    def begin(s: Column, x: Column) -> Column:
        return F.when(s["kind"] == x["kind"], s["at"]).otherwise(F.lit(0).cast("long")) + x["gap"]

    state = F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("at"))
    places = running(F.col("lengths"), state, lambda s, x: F.struct(x["kind"].alias("kind"), (begin(s, x) + x["hit"]).alias("at")), lambda s, x: F.struct(begin(s, x).alias("start"), x["kind"].alias("kind"), (begin(s, x) + x["hit"]).alias("end"), x["keep"].alias("keep")), "struct<start:long,kind:int,end:long,keep:boolean>")
    kept = F.transform(F.filter(places, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return rows.select(*keep, F.sort_array(kept).alias("parts"))


def _linked(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (with a ``_`` before), text and spans: the base parts and those weak ones that are linked."""
    keep = [f"_{c}" for c in columns] + ["text"]
    rows = _located(docs, *columns)
    none = F.lit(None).cast("long")
    roles = {"identifier": (1, 3), "secret": (0, 2, 4)}
    near = {k: f"near_{k}" for k in roles}
    flagged = PART.replace("end:long", "end:long,near_identifier:boolean,near_secret:boolean")

    def sweep(items: Column, edge: str, best: Callable, distance: Callable, before: Callable) -> Column:
        """Marks each part whose scope meets that of an identifier, or a secret, that came before it."""
        return running(
            items,
            F.struct(*[none.alias(k) for k in roles]),
            lambda s, x: F.struct(*[best(s[k], F.when(x["kind"].isin(*kinds), x[edge])).alias(k) for k, kinds in roles.items()]),
            lambda s, x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end")], *[(before(x, near[k]) | F.coalesce(distance(s[k], x) <= 2 * SCOPE, F.lit(False))).alias(near[k]) for k in roles]),
            flagged,
        )

    # in texts without a weak part nothing is to be linked
    weak = F.exists("parts", lambda x: x["kind"] >= 3)
    rows = rows.select(*keep, F.when(weak, F.array().cast(SPAN)).otherwise(F.col("parts")).alias("base"), F.when(weak, F.col("parts")).otherwise(F.array().cast(SPAN)).alias("parts"))
    keep.append("base")
    rows = rows.select(*keep, sweep(F.col("parts"), "end", F.greatest, lambda at, x: x["start"] - at, lambda x, c: F.lit(False)).alias("ahead"))
    rows = rows.select(*keep, F.reverse("ahead").alias("ahead"))
    rows = rows.select(*keep, sweep(F.col("ahead"), "start", F.least, lambda at, x: at - x["end"], lambda x, c: x[c]).alias("both"))

    def reported(x: Column) -> Column:
        identifier, secret = x[near["identifier"]], x[near["secret"]]
        return (x["kind"] < 3) | F.when(x["kind"] == 3, secret).when(x["kind"] == 4, identifier).otherwise(identifier & secret)

    found = F.transform(F.filter(F.reverse("both"), reported), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end")]))
    return rows.select(*keep[:-1], F.concat("base", found).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, kind, end: base and linked ones, by start and kind) of every row."""
    return _linked(docs, "doc_id").select(F.col("_doc_id").cast("long").alias("doc_id"), "spans")


def _joined(parts: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    found = scan(docs)
    found = found.select("doc_id", "spans", F.filter("spans", lambda x: x["kind"] < 3).alias("base"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(n) for n, k in enumerate(KINDS[:3])}
    return found.select("doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to ``end`` of the text that was cut into ``chunks``."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head = F.coalesce(F.get(chunks, a), F.lit(""))
    left, right = F.pmod(start, F.lit(CHUNK)).cast("int"), F.pmod(end, F.lit(CHUNK)).cast("int")
    across = F.concat(F.substring(head, left + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), right))
    return F.when(a == b, F.substring(head, left + 1, right - left)).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` in all their columns, each span of their texts replaced by a mark.

    Overlapping spans have one mark.  A null text stays null.
    """
    rest = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("rest")
    rows = _linked(docs.select(rest, "text"), "rest")
    some = F.size("spans") > 0
    reach = running(F.col("spans"), F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["end"]), lambda s, x: F.struct(s.alias("a"), x["start"].alias("b")), "struct<a:long,b:long>")
    gaps = F.filter(reach, lambda x: x["a"] <= x["b"])
    rows = rows.select("_rest", "text", gaps.alias("gaps"), F.array_max(F.transform("spans", lambda x: x["end"])).alias("last"), F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunks"))
    chunks = F.col("chunks")
    pieces = F.transform("gaps", lambda g: _piece(chunks, g["a"], g["b"]))
    clean = F.concat(F.array_join(pieces, MARK), F.lit(MARK), _piece(chunks, F.col("last"), F.length("text").cast("long")))
    text = F.when(F.size("gaps") > 0, clean).otherwise(F.col("_rest.text").cast("string"))
    return rows.select(*[(text if c == "text" else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
