"""Merging, de-duplication and deletes of point frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_sources(*frames: DataFrame, order: Sequence[str] = ("timestamp",), sort: bool = True) -> DataFrame:
    """The bag union of frames with ``src``, their number; in time order, equal times by source.

    Nothing is dropped: the same time and series twice comes back twice.
    """
    out = None
    for n, frame in enumerate(frames):
        frame = frame.withColumn("src", F.lit(n))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out.orderBy(order[0], "src", *order[1:]) if sort else out


def dedup(df: DataFrame, key: Sequence[str] = ("timestamp", "series_key"), seq: Sequence[str | Column] = ("part_seq",), keep: str = "first") -> DataFrame:
    """One row per key: the first or the last in ``seq``."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep}")
    order = [F.col(c) if isinstance(c, str) else c for c in seq]
    by = Window.partitionBy(*key).orderBy(*(c.asc() if keep == "first" else c.desc() for c in order))
    return df.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def dedup_times(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """One row per time, whatever its series: the first in ``seq``."""
    return dedup(df, ("timestamp",), seq, "first")


def without_deleted(df: DataFrame, tombstones: DataFrame, series: str = "series_key", time: str = "timestamp") -> DataFrame:
    """Rows that no tombstone (series, mint, maxt: both inclusive) of their series covers.

    The series is an equality key of the anti-join, so Catalyst broadcasts tombstones while they are
    small by its own measure and hashes both sides beyond that.
    """
    t = tombstones.select(F.col(series).alias("__series"), "mint", "maxt")
    covered = (F.col(series) == F.col("__series")) & (F.col(time) >= F.col("mint")) & (F.col(time) <= F.col("maxt"))
    return df.join(t, covered, "left_anti")


def live_tombstones(tombstones: DataFrame, now: int, retention: int) -> DataFrame:
    """Tombstones younger than ``retention`` ns."""
    return tombstones.where(F.lit(now) - F.col("deleted") < retention)


def compacted(df: DataFrame, tombstones: DataFrame | None = None, keep: str = "first", seq: Sequence[str] = ("part_seq",)) -> DataFrame:
    """What a compaction of parts writes: one row per time and series, deletes applied."""
    out = dedup(df, seq=seq, keep=keep)
    return without_deleted(out, tombstones) if tombstones is not None else out
