"""Streaming ingest into a measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..functions import series_key
from ..model import Shape


def deduplicated(stream: DataFrame, shape: Shape, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a time and series that come within ``delay`` of each other."""
    timed = stream.withColumns({"__event": F.timestamp_micros(F.expr(f"{shape.time} div 1000")), "__series": series_key(shape.tags)})
    return timed.withWatermark("__event", delay).dropDuplicatesWithinWatermark([shape.time, "__series"]).drop("__event", "__series")


def ingest(engine: Engine, stream: DataFrame, database: str, measurement: str, shape: Shape, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every micro-batch to a measurement, each once: a batch that is replayed after a crash is recognised by its number.

    Rows with a negative or null time are left out.  The engine ends the stream when it is closed.
    """

    def append(batch: DataFrame, number: int) -> None:
        engine.write_frame(database, measurement, batch, shape, once=(checkpoint, number))

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    engine.streams.append(query)
    return query
