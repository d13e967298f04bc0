"""Command line: ``scan`` prints a table, ``gen`` makes a data file of a CSV file."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession

from tidemark.asof import parse_instant
from tidemark.errors import TimeError
from tidemark.lakehouse import Lakehouse
from tidemark.writer import generate


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    scan, gen = sub.add_parser("scan"), sub.add_parser("gen")
    for p in (scan, gen):
        p.add_argument("--path", required=True)
        p.add_argument("--table", required=True)
    scan.add_argument("--as-of", help="YYYY-MM-DDTHH:mm:ss, in UTC")
    gen.add_argument("--file", required=True, help="CSV file; the data file is named like it")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lake = Lakehouse(spark, a.path)
    if a.command == "gen":
        generate(lake, a.table, a.file, re.sub(r"(\.csv)?$", ".parquet", a.file.rsplit("/", 1)[-1], count=1))
        return 0
    at = None
    if a.as_of is not None:
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", a.as_of):
            raise TimeError("--as-of must be YYYY-MM-DDTHH:mm:ss")
        at = parse_instant(a.as_of + ".000Z")
    lake.scan(a.table, at).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
