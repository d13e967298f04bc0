"""Scalar functions that Spark SQL lacks or spells otherwise, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skipping_nulls(*columns: Column) -> Column:
    return F.concat_ws("", *columns)


def date_bin(width_s: int, at: Column, origin_s: int = 0) -> Column:
    """Start of the bin of ``width_s`` seconds, counted from the origin, that holds the instant."""
    us = F.unix_micros(at.cast("timestamp")) - origin_s * 1_000_000
    width = width_s * 1_000_000
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)) + origin_s * 1_000_000)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 93 of them suffice for 64 bits."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))

    def step(x: Column, _: Column) -> Column:
        rest = F.when(x["b"] == 0, x["b"]).otherwise(F.try_mod(x["a"], x["b"]))
        return F.struct(F.when(x["b"] == 0, x["a"]).otherwise(x["b"]).alias("a"), rest.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda x: x["a"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; raises only where it doesn't fit 64 bits itself."""
    part = F.call_function("div", F.abs(a).cast("long"), F.when((a == 0) | (b == 0), F.lit(1).cast("long")).otherwise(gcd(a, b)))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(part * F.abs(b).cast("long"))


def iszero(x: Column) -> Column:
    return x == 0


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero, to so many decimal digits."""
    return F.signum(x) * F.floor(F.abs(x) * 10**digits) / 10**digits


def split_part_or_empty(text: Column, by: str, part: int) -> Column:
    return F.split_part(text, F.lit(by), F.lit(part))


def regexp_replace_first(text: Column, pattern: str, by: str) -> Column:
    """Only the first match is replaced, by ``by`` as it stands; the pattern may have groups of its own."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_extract(text, pattern, 0))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + size, F.length(text)))).otherwise(text)
