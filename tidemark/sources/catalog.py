"""The catalog: databases, measurements, their schemas and settings, as one versioned document."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..model import FieldTypeMismatch, InvalidPoint, NotFound, safe_name
from .files import Files
from .versions import Versioned


class Catalog:
    """Reads the document anew for every call; every change is one new version, safe beside other writers."""

    def __init__(self, spark: SparkSession, base: str):
        self.doc = Versioned(Files(spark), f"{base}/_catalog")

    def _load(self) -> dict:
        return self.doc.load()

    def databases(self) -> list[str]:
        """Names in order; those that begin with an underscore are hidden."""
        return sorted(d for d in self._load() if not d.startswith("_"))

    def create_database(self, database: str) -> None:
        self.doc.update(lambda doc: doc.setdefault(safe_name(database), {}))

    def drop_database(self, database: str) -> None:
        def change(doc: dict) -> None:
            if doc.pop(database, None) is None:
                raise NotFound(f"no database {database}")

        self.doc.update(change)

    def measurements(self, database: str) -> list[str]:
        """Names in order; none for an unknown database."""
        return sorted(self._load().get(database, {}))

    def create_measurement(self, database: str, measurement: str) -> None:
        def change(doc: dict) -> None:
            if safe_name(database) not in doc:
                raise NotFound(f"no database {database}")
            doc[database].setdefault(safe_name(measurement), {"retention": 0, "tags": [], "schema": {"version": 0, "fields": {}, "updated_at": 0}})

        self.doc.update(change)

    def drop_measurement(self, database: str, measurement: str) -> None:
        def change(doc: dict) -> None:
            if database not in doc:
                raise NotFound(f"no database {database}")
            if doc[database].pop(measurement, None) is None:
                raise NotFound(f"no measurement {database}/{measurement}")

        self.doc.update(change)

    def has(self, database: str, measurement: str) -> bool:
        return measurement in self._load().get(database, {})

    def _entry(self, doc: dict, database: str, measurement: str) -> dict:
        try:
            return doc[database][measurement]
        except KeyError:
            raise NotFound(f"no measurement {database}/{measurement}") from None

    def schema(self, database: str, measurement: str) -> dict | None:
        """version, fields (name to type), updated_at; None before the first one is set."""
        schema = self._entry(self._load(), database, measurement)["schema"]
        return schema if schema["version"] else None

    def tags(self, database: str, measurement: str) -> list[str]:
        return self._entry(self._load(), database, measurement)["tags"]

    def set_schema(self, database: str, measurement: str, fields: Mapping[str, str], tags: list[str] | None = None, keep: bool = False) -> int:
        """A new version with these fields (and, with ``keep``, all known ones); a field's type never changes. Returns the version."""
        def change(doc: dict) -> int:
            entry = self._entry(doc, database, measurement)
            known = entry["schema"]["fields"]
            for name, kind in fields.items():
                if known.get(name, kind) != kind:
                    raise FieldTypeMismatch(f"{name} is {known[name]}, not {kind}")
            every = known | dict(fields) if keep else dict(fields)
            named = sorted({*entry["tags"], *(tags or [])})
            if every != known or named != entry["tags"] or not entry["schema"]["version"]:
                entry["schema"] = {"version": entry["schema"]["version"] + 1, "fields": every, "updated_at": time.time_ns()}
                entry["tags"] = named
            return entry["schema"]["version"]

        return self.doc.update(change)

    def retention(self, database: str, measurement: str) -> int:
        return self._entry(self._load(), database, measurement)["retention"]

    def set_retention(self, database: str, measurement: str, nanos: int) -> None:
        if nanos < 0:
            raise InvalidPoint("a retention is no negative time")
        self.doc.update(lambda doc: self._entry(doc, database, measurement).update(retention=nanos))

    # ---- the shard registry

    def register_shard(self, database: str, measurement: str, start: int, end: int, **stats: int) -> None:
        """Note a shard [start, end); one of the same start is replaced."""
        if end <= start:
            raise InvalidPoint("a shard ends after it starts")
        self.doc.update(lambda doc: self._entry(doc, database, measurement).setdefault("shards", {}).update({str(start): {"start": start, "end": end, **stats}}))

    def replace_shards(self, database: str, measurement: str, shards: list[dict]) -> None:
        """Note these shards (start, end and counts) and no others, as one change."""
        self.doc.update(lambda doc: self._entry(doc, database, measurement).update(shards={str(s["start"]): s for s in shards}))

    def unregister_shard(self, database: str, measurement: str, start: int) -> None:
        def change(doc: dict) -> None:
            if self._entry(doc, database, measurement).get("shards", {}).pop(str(start), None) is None:
                raise NotFound(f"no shard {start}")

        self.doc.update(change)

    def registered_shards(self, database: str, measurement: str, start: int | None = None, end: int | None = None) -> list[dict]:
        """Registered shards by start, or those that meet [start, end)."""
        found = sorted(self._entry(self._load(), database, measurement).get("shards", {}).values(), key=lambda s: s["start"])
        return [s for s in found if (end is None or s["start"] < end) and (start is None or s["end"] > start)]

    def update_shard(self, database: str, measurement: str, start: int, **stats: int) -> None:
        """Replace counts of a registered shard."""
        def change(doc: dict) -> None:
            shards = self._entry(doc, database, measurement).get("shards", {})
            if str(start) not in shards:
                raise NotFound(f"no shard {start}")
            shards[str(start)] |= stats

        self.doc.update(change)
