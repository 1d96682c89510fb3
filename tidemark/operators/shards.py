"""Shards (time windows of a measurement) and blocks (runs of rows within one)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shard_start
from .ordinals import with_position

BLOCK_ROWS = 8192


def with_shard(df: DataFrame, width: int, time: str = "timestamp") -> DataFrame:
    """``df`` with shard_start and shard_end of each row's window."""
    return df.withColumn("shard_start", shard_start(time, width)).withColumn("shard_end", F.col("shard_start") + F.lit(width))


def shard_stats(df: DataFrame, width: int, series: Sequence[str] = (), time: str = "timestamp") -> DataFrame:
    """Per shard: rows, min_time, max_time and the number of series."""
    counted = F.countDistinct(F.to_json(F.struct(*series))) if series else F.lit(0)
    return with_shard(df, width, time).groupBy("shard_start", "shard_end").agg(
        F.count("*").alias("n_points"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), counted.cast("long").alias("n_series")
    )


def overlapping_shards(shards: DataFrame, start: int, end: int) -> DataFrame:
    """Shards [shard_start, shard_end) that meet [start, end), by start."""
    return shards.where((F.col("shard_start") < end) & (F.col("shard_end") > start)).orderBy("shard_start")


def window_starts(start: int, end: int, width: int) -> list[int]:
    """The starts of all windows that meet [start, end)."""
    if start >= end:
        return []
    if width <= 0:
        return [0]
    return list(range(start // width * width, end, width))


def block_index(df: DataFrame, width: int, ties: Sequence[str] = (), rows: int = BLOCK_ROWS, time: str = "timestamp") -> DataFrame:
    """Per shard and block of ``rows`` rows in time order: first_time, last_time and n_rows."""
    placed = with_position(df.select(time, *(t for t in ties if t != time)).withColumn("shard_start", shard_start(time, width)), ["shard_start", time, *ties])
    heads = placed.groupBy("shard_start").agg(F.min("position").alias("__head"))
    placed = placed.join(heads, "shard_start").withColumn("block", F.expr(f"(position - __head) div {rows}"))
    return placed.groupBy("shard_start", "block").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_rows"))


def find_block(index: DataFrame, time: int) -> DataFrame:
    """Per shard, the first block whose last time is at or after ``time``; past the end, the number of blocks."""
    return index.groupBy("shard_start").agg(F.coalesce(F.min(F.when(F.col("last_time") >= time, F.col("block"))), F.count("*")).cast("long").alias("block"))
