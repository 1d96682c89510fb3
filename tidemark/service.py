"""The engine's remote-call surface as plain Python: requests and replies are dictionaries.

The transport is left to whoever hosts it (Spark Connect reaches the DataFrame API itself); this
module holds the ten calls, their conversions and their status codes.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from .engine import Engine
from .model import VERSION, EngineError, InvalidPoint, NotFound, Point, type_name

OK, NOT_FOUND, INTERNAL = "OK", "NOT_FOUND", "INTERNAL"


class CallError(Exception):
    """A refused call and its status code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def box(value: int | float | str | bool) -> dict[str, Any]:
    """A field value with its type: {"int64": 1}; other kinds are refused."""
    return {type_name(value): value}


def unbox(boxed: Mapping[str, Any]) -> int | float | str | bool:
    """The value of a boxed field; one of an unknown type, or none at all, is refused."""
    if len(boxed) != 1 or next(iter(boxed)) not in ("int64", "float64", "string", "bool"):
        raise InvalidPoint(f"no field value: {dict(boxed)}")
    kind, value = next(iter(boxed.items()))
    return {"int64": int, "float64": float, "string": str, "bool": bool}[kind](value)


def to_point(request: Mapping[str, Any]) -> Point:
    """A point of a write request with boxed fields."""
    fields = {k: unbox(v) for k, v in request.get("fields", {}).items()}
    return Point(request.get("database", ""), request.get("measurement", ""), request.get("timestamp", 0), dict(request.get("tags", {})), fields)


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _refusing(self, code: str, call, *args):
        try:
            return call(*args)
        except EngineError as e:
            raise CallError(code, str(e)) from e

    def write(self, request: Mapping[str, Any]) -> dict:
        self._refusing(INTERNAL, lambda: self.engine.write(to_point(request)))
        return {"success": True}

    def write_batch(self, requests: list[Mapping[str, Any]]) -> dict:
        self._refusing(INTERNAL, lambda: self.engine.write_batch([to_point(r) for r in requests]))
        return {"success": True, "written": len(requests)}

    def query_range(self, request: Mapping[str, Any]) -> dict:
        """database, measurement, start, end and, if wanted, tags, fields, offset, limit."""
        q = request
        page = self._refusing(
            INTERNAL, self.engine.query_range, q["database"], q["measurement"], q["start"], q["end"], q.get("tags"), q.get("fields", ()), q.get("offset", 0), q.get("limit", 0)
        )
        tags = set(self.engine.shape(page.database, page.measurement).tags) if page.rows else set()
        rows = []
        for r in page.rows:
            values = {k: v for k, v in r.asDict().items() if v is not None}
            time = values.pop("timestamp")
            rows.append({"timestamp": time, "tags": {k: v for k, v in values.items() if k in tags}, "fields": {k: box(v) for k, v in values.items() if k not in tags}})
        return {"database": page.database, "measurement": page.measurement, "start": page.start, "end": page.end, "rows": rows, "total_count": page.total_count, "has_more": page.has_more}

    def list_databases(self) -> list[str]:
        return self._refusing(INTERNAL, self.engine.list_databases)

    def create_database(self, database: str) -> None:
        self._refusing(INTERNAL, self.engine.create_database, database)

    def drop_database(self, database: str) -> None:
        self._dropping(self.engine.drop_database, database)

    def list_measurements(self, database: str) -> list[str]:
        return self._refusing(INTERNAL, self.engine.list_measurements, database)

    def create_measurement(self, database: str, measurement: str) -> None:
        self._refusing(INTERNAL, self.engine.create_measurement, database, measurement)

    def drop_measurement(self, database: str, measurement: str) -> None:
        self._dropping(self.engine.drop_measurement, database, measurement)

    def _dropping(self, call, *names: str) -> None:
        try:
            call(*names)
        except NotFound as e:
            raise CallError(NOT_FOUND, str(e)) from e

    def health(self) -> dict:
        return {"healthy": True, "version": VERSION}
