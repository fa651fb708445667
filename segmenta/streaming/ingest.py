"""Continuous loading of a translation memory with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmenta.operators.memory import TranslationMemory
from segmenta.schema import UNIT_COLUMNS, unit_type


def stream_into(units: DataFrame, memory: TranslationMemory, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert a stream of units, one micro-batch at a time.

    The upsert is keyed, so rows that come again replace themselves; it needs no
    watermark.  A batch that is repeated after a failure counts uses once more and
    changes nothing else.
    """

    def load(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                memory.load(held)
        finally:
            held.unpersist()

    out = units.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def unit_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of units from files with one JSON unit in a line; missing maps and arrays are empty."""
    raw = spark.readStream.schema(unit_type()).json(path)
    empty = {"extensions": "map<string,string>", "targets": unit_type()["targets"].dataType.simpleString()}
    out = raw
    for name, kind in empty.items():
        out = out.withColumn(name, F.coalesce(name, F.create_map().cast(kind)))
    return out.select(*UNIT_COLUMNS)


def batches(units: DataFrame, size: int, callback: Callable[[list], None]) -> int:
    """Hand units over in order, ``size`` at a time; returns their number."""
    held, n = [], 0
    for row in units.orderBy("doc_id", "ordinal").toLocalIterator(prefetchPartitions=True):
        held.append(row)
        n += 1
        if len(held) == size:
            callback(held)
            held = []
    if held:
        callback(held)
    return n


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than ``late`` are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"))
