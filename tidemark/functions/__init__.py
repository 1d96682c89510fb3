"""Column functions and codecs of the time-series model, all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FIELD_TYPES


def shard_start(time: Column | str, width: int) -> Column:
    """The start of the window of ``width`` ns that holds a time; 0 where width isn't positive."""
    time = F.col(time) if isinstance(time, str) else time
    if width <= 0:
        return F.lit(0).cast("long")
    return (time - time % F.lit(width)).cast("long")


def contains_time(start: Column | str, end: Column | str, time: Column | int) -> Column:
    """Whether [start, end) holds a time."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= time) & (F.lit(time) < end)


def series_key(tags: Sequence[str]) -> Column:
    """Canonical JSON of a row's tags, by name; tags that are null are left out."""
    return F.to_json(F.struct(*sorted(tags))) if tags else F.lit("{}")


def series_key_of_map(tags: Column | str) -> Column:
    """The same of a map column; the order of its entries doesn't count."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags)))), F.lit("{}"))


def zero_fill(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Missing fields become the zero of their type (name -> int64, float64, string or bool)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(FIELD_TYPES[kind][1])) for c, kind in fields.items()})


def delta_encode(df: DataFrame, column: str, within: Sequence[str], order: Sequence[str], to: str = "delta") -> DataFrame:
    """The first value of each group, then differences."""
    by = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(to, F.col(column) - F.lag(column, 1, 0).over(by))


def delta_decode(df: DataFrame, column: str, within: Sequence[str], order: Sequence[str], to: str = "value") -> DataFrame:
    """Running sums of each group: the inverse of ``delta_encode``."""
    by = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.sum(column).over(by))


def varint_length(column: str) -> Column:
    """Bytes of the unsigned LEB128 form of a long."""
    out = F.when(F.col(column) < 0, 10)
    for n in range(1, 10):
        out = out.when(F.col(column) < F.lit(1 << (7 * n)) if n < 9 else F.lit(True), n)
    return out


def varint_encode(column: str) -> Column:
    """The unsigned LEB128 form of a long, as binary."""
    length = varint_length(column)
    byte = lambda i: F.col(column).cast("long")  # noqa: E731, ARG005
    parts = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", byte(i), (i * 7).cast("int")).bitwiseAND(127).bitwiseOR(F.when(i < length - 1, 128).otherwise(0).cast("long"))), 2, "0"),
    )
    return F.unhex(F.array_join(parts, ""))


def varint_decode(column: str) -> Column:
    """The long of an unsigned LEB128 binary; null where it is empty, cut short or too long."""
    size = F.octet_length(column)
    code = lambda i: F.conv(F.hex(F.substring(F.col(column), i + 1, F.lit(1))), 16, 10).cast("long")
    places = F.sequence(F.lit(0), size - 1)
    total = F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", code(i).bitwiseAND(127), (i * 7).cast("int"))))
    ended = (code(size - 1) < 128) & F.forall(places, lambda i: (i == size - 1) | (code(i) >= 128))
    return F.when((size > 0) & (size <= 10) & ended, total)
