"""The series dictionary: distinct tag sets of a measurement and their numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series_key
from .ordinals import with_position


def dictionary(df: DataFrame, tags: Sequence[str], seq: str, known: DataFrame | None = None) -> DataFrame:
    """series_id (from 0 by first appearance), series_key and the tags.

    With ``known``, its series keep their numbers and new ones follow the largest.  Numbers are given
    by ranges of the order, so a measurement of very many series needs no global window.
    """
    found = df.withColumn("series_key", series_key(tags)).groupBy("series_key", *tags).agg(F.min(seq).alias("__first"))
    if known is not None:
        found = found.join(known.select("series_key"), "series_key", "left_anti")
    found, shift = with_position(found, ["__first", "series_key"], "__place"), F.lit(0)
    if known is not None:
        top = known.agg(F.coalesce(F.max("series_id") + 1, F.lit(0)).alias("__top"))
        found, shift = found.crossJoin(F.broadcast(top)), F.col("__top")  # one row
    new = found.select((F.col("__place") + shift).cast("long").alias("series_id"), "series_key", *tags)
    return known.select("series_id", "series_key", *tags).unionByName(new) if known is not None else new


def resolve(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Rows with the series columns of their series_id; an unknown number keeps its row with nulls."""
    return rows.join(series, "series_id", "left")


def tag_pairs(series: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The inverted index: tag, value, series_id for every tag that a series has."""
    entries = F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in sorted(tags)))
    return series.select("series_id", F.explode(entries).alias("e")).select("e.tag", "e.value", "series_id").where("value is not null")


def series_with_tag(index: DataFrame, tag: str, value: str) -> DataFrame:
    return index.where((F.col("tag") == tag) & (F.col("value") == value)).select("series_id")


def series_count(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.agg(F.countDistinct(series_key(tags)).alias("n_series"))
