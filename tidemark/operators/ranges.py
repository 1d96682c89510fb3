"""Range queries: half-open time ranges, tag filters, projection, pages and the response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..model import Shape


def in_range(df: DataFrame, shape: Shape, start: int, end: int | None) -> DataFrame:
    """Rows with start <= time < end; None is open-ended; an end at or below 0 or start holds nothing."""
    time = F.col(shape.time)
    if end is None:
        return df.where(time >= start)
    if end <= 0 or end <= start:
        return df.where(F.lit(False))
    return df.where((time >= start) & (time < end))


def with_tags(df: DataFrame, shape: Shape, tags: Mapping[str, str]) -> DataFrame:
    """Rows whose tags equal all given ones; the empty string also matches rows without the tag."""
    for tag, value in tags.items():
        if tag not in shape.tags:
            if value != "":
                return df.where(F.lit(False))
        elif value == "":
            df = df.where(F.coalesce(F.col(tag), F.lit("")) == "")
        else:
            df = df.where(F.col(tag) == value)
    return df


def project(df: DataFrame, shape: Shape, fields: Sequence[str] = ()) -> DataFrame:
    """Time, tags and the named fields, once each, in stored order; unknown names are ignored, no name is all."""
    wanted = [f for f in shape.fields if not fields or f in set(fields)]
    return df.select(shape.time, *shape.tags, *wanted)


def matching(df: DataFrame, shape: Shape, start: int, end: int | None, tags: Mapping[str, str] | None = None) -> DataFrame:
    return with_tags(in_range(df, shape, start, end), shape, tags or {})


def range_query(
    df: DataFrame, shape: Shape, start: int, end: int | None, tags: Mapping[str, str] | None = None, fields: Sequence[str] = (), offset: int = 0, limit: int = 0
) -> DataFrame:
    """Matching rows in ascending time; ``offset`` matching rows are skipped, ``limit`` of 0 is all.

    With a limit the plan keeps offset + limit rows per task (no full sort); without one it is a
    range exchange and a sort.
    """
    out = matching(df, shape, start, end, tags).orderBy(*shape.order())
    if offset > 0:
        out = out.offset(offset)
    if limit > 0:
        out = out.limit(limit)
    return project(out, shape, fields)


def envelope(df: DataFrame, shape: Shape, start: int, end: int | None, tags: Mapping[str, str] | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """total_count (rows skipped and returned) and has_more (a full page was returned) of a page, as one row."""
    seen = matching(df, shape, start, end, tags).select(F.lit(1).alias("one"))
    if limit > 0:
        seen = seen.limit(offset + limit)
    n = seen.agg(F.count("*").alias("n"))
    more = (F.col("n") - offset >= limit) if limit > 0 else F.lit(False)
    return n.select(F.col("n").cast("long").alias("total_count"), more.alias("has_more"))


@dataclass
class Response:
    """A materialised page."""

    database: str
    measurement: str
    start: int
    end: int | None
    rows: list[Row]
    total_count: int
    has_more: bool
