"""Continuous upserts: each micro-batch becomes deltas and a snapshot."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.asof import EPOCH
from tidemark.lakehouse import Lakehouse
from tidemark.schema import EVENT_TIME, KEY
from tidemark.sources.store import Store
from tidemark.writer import upsert


def ingest(lake: Lakehouse, table: str, rows: DataFrame, checkpoint: str, lateness: str = "1 hour", available_now: bool = True, files: int = 1) -> StreamingQuery:
    """Start a query that appends the stream's updates; (key, event_time) counts once within the lateness.

    A batch is known by the query's id, which its checkpoint keeps, and its
    number.  One that runs again after a failure finds its deltas in the
    snapshot, or its mark in the table's folder, and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(Store(lake.spark, checkpoint).read_text("metadata"))["id"]
        name = f"{query}_{number}"
        if lake.store.exists(table, f"_batch_{name}"):
            # the stream's state must be brought up to date all the same
            batch.write.format("noop").mode("overwrite").save()
            return
        batch = batch.persist()
        try:
            span = batch.agg(F.min(F.unix_micros(EVENT_TIME)), F.max(F.unix_micros(EVENT_TIME))).first()
            if span[0] is not None:
                upsert(lake, table, batch, *(EPOCH + timedelta(microseconds=x) for x in span), files, f"batch-{name}")
        finally:
            batch.unpersist()
        lake.store.write_text("", table, f"_batch_{name}")

    unique = rows.withWatermark(EVENT_TIME, lateness).dropDuplicatesWithinWatermark([KEY, EVENT_TIME])
    writer = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
