"""Points, measurements and errors.

A point is a time in nanoseconds (BIGINT: Spark's timestamps stop at microseconds), string tags and
typed fields.  Stored and queried frames are wide: ``timestamp``, one nullable string column per tag,
one nullable typed column per field.  A ``Shape`` names which column is which.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
WEEK = 7 * DAY
VERSION = "1.0.0"


class EngineError(Exception):
    """Any refusal of the engine."""


class InvalidPoint(EngineError):
    """A point without database or measurement, with a negative time, or no point at all."""


class NotFound(EngineError):
    """A database, measurement or time range that isn't there."""


class FieldTypeMismatch(EngineError):
    """A field that was stored with one type and comes with another."""


class Conflict(EngineError):
    """Another writer changed the same files first."""


class Closed(EngineError):
    """The engine was closed."""


@dataclass(frozen=True)
class Shape:
    """Which columns of a frame are tags and fields, and what orders rows of equal time."""

    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    time: str = "timestamp"

    def order(self) -> list[Column]:
        return [F.col(self.time), *(F.col(c) for c in self.ties)]


@dataclass
class Point:
    """One row to write."""

    database: str
    measurement: str
    timestamp: int
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, int | float | str | bool] = field(default_factory=dict)


#: Field types by name, and what stands for a missing value where a reader asks for no nulls.
FIELD_TYPES: dict[str, tuple[T.DataType, object]] = {
    "int64": (T.LongType(), 0),
    "float64": (T.DoubleType(), 0.0),
    "string": (T.StringType(), ""),
    "bool": (T.BooleanType(), False),
}


def type_name(value: object) -> str:
    """The field type of a Python value; raises for any other kind."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int64"
    if isinstance(value, float):
        return "float64"
    if isinstance(value, str):
        return "string"
    raise InvalidPoint(f"no field type for {type(value).__name__}")


def spark_type_name(kind: T.DataType) -> str:
    """The field type of a Spark type, integers and floats of any width being widened."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int64"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "float64"
    if isinstance(kind, T.StringType):
        return "string"
    raise InvalidPoint(f"no field type for {kind.simpleString()}")


_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*")


def safe_name(name: str | None) -> str:
    """A database or measurement name that may be a path segment."""
    if not name:
        raise InvalidPoint("the name is empty")
    if not _NAME.fullmatch(name) or ".." in name:
        raise InvalidPoint(f"not a name: {name!r}")
    return name
