"""The engine: databases and measurements on a base path, with the calls of a time-series store."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .functions import zero_fill
from .model import FIELD_TYPES, SECOND, VERSION, WEEK, Closed, Conflict, EngineError, FieldTypeMismatch, InvalidPoint, NotFound, Point, Shape, safe_name, type_name
from .operators import ingest, maintenance, merge, ranges, series, shards
from .sources.catalog import Catalog
from .sources.files import Files
from .sources.measurements import found_parts, read_points, rewrite_points, schema_of, stored_points, write_points
from .sources.versions import Versioned

#: Bytes of a file that a compaction aims at.
FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Config:
    """base: any path that Spark can write; shard_width, retention (0: none) and grace in ns.

    grace: how long files that no longer count stay for those who may still read them.
    skip_unreadable: leave out files that are broken or gone, instead of failing.
    """

    base: str
    shard_width: int = WEEK
    retention: int = 0
    grace: int = 600 * SECOND
    skip_unreadable: bool = False


class Engine:
    """All methods raise ``Closed`` after ``close``."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.closed = spark, config, False
        self.files, self.catalog = Files(spark), Catalog(spark, config.base)
        self.streams: list[StreamingQuery] = []
        self._stopping, self._upkeep = threading.Event(), None
        self.files.make(config.base)
        self.recover()

    def _open(self) -> None:
        if self.closed:
            raise Closed("the engine is closed")

    def _path(self, database: str, measurement: str) -> str:
        return f"{self.config.base}/{safe_name(database)}/{safe_name(measurement)}"

    def _manifest(self, database: str, measurement: str) -> Versioned:
        """parts, gone, tombstones (batches of marks), batches (the number of the next write) and streams (last batch stored)."""
        return Versioned(self.files, f"{self._path(database, measurement)}/_manifest")

    # ---- catalog

    def list_databases(self) -> list[str]:
        self._open()
        return self.catalog.databases()

    def create_database(self, database: str) -> None:
        self._open()
        self.catalog.create_database(database)

    def drop_database(self, database: str) -> None:
        """Forget a database; files stay."""
        self._open()
        self.catalog.drop_database(database)

    def list_measurements(self, database: str) -> list[str]:
        self._open()
        return self.catalog.measurements(database)

    def create_measurement(self, database: str, measurement: str) -> None:
        self._open()
        self.catalog.create_measurement(database, measurement)

    def drop_measurement(self, database: str, measurement: str) -> None:
        """Forget a measurement; files stay."""
        self._open()
        self.catalog.drop_measurement(database, measurement)

    def create_empty_measurement(self, database: str, measurement: str) -> None:
        """Only its folder."""
        self._open()
        self.files.make(self._path(database, measurement))

    @property
    def data_dir(self) -> str:
        return self.config.base

    def health(self) -> DataFrame:
        return health(self.spark)

    # ---- writes

    def write(self, point: Point) -> None:
        self.write_batch([point])

    def write_batch(self, points: Iterable[Point]) -> None:
        """Write points in order; at the first bad one, those before it are written and the refusal is raised."""
        self._open()
        groups: dict[tuple[str, str], list[Point]] = {}
        kinds: dict[tuple[str, str], dict[str, str]] = {}
        refusal: EngineError | None = None
        for p in points:
            try:
                _check(p)
                at = (p.database, p.measurement)
                known = kinds.get(at)
                if known is None:
                    schema = self.catalog.schema(*at) if self.catalog.has(*at) else None
                    known = kinds[at] = dict(schema["fields"]) if schema else {}
                for f, v in p.fields.items():
                    if known.get(f, type_name(v)) != type_name(v):
                        raise FieldTypeMismatch(f"{f} is {known[f]}, not {type_name(v)}")
                known |= {f: type_name(v) for f, v in p.fields.items()}
            except EngineError as e:
                refusal = e
                break
            groups.setdefault(at, []).append(p)
        for at, own in groups.items():
            tags, fields = sorted({t for p in own for t in p.tags}), sorted({f for p in own for f in p.fields}, key=list(kinds[at]).index)
            schema = T.StructType([T.StructField("timestamp", T.LongType()), *(T.StructField(t, T.StringType()) for t in tags), *(T.StructField(f, FIELD_TYPES[kinds[at][f]][0]) for f in fields)])
            rows = [(p.timestamp, *(p.tags.get(t) for t in tags), *(p.fields.get(f) for f in fields)) for p in own]
            self.write_frame(*at, self.spark.createDataFrame(rows, schema).coalesce(1), Shape(tuple(tags), tuple(fields)))
        if refusal:
            raise refusal

    def write_frame(self, database: str, measurement: str, df: DataFrame, shape: Shape, once: tuple[str, int] | None = None) -> bool:
        """Append a wide frame as one change; the database and measurement come to be, and the schema is checked first.

        once: the name of a stream and the number of its batch; a batch whose number was stored already
        is left out.  Returns whether the frame was stored.
        """
        self._open()
        if not database or not measurement:
            raise InvalidPoint("a point has a database and a measurement")
        self.catalog.create_database(database)
        self.catalog.create_measurement(database, measurement)
        manifest, path = self._manifest(database, measurement), self._path(database, measurement)
        stored = lambda doc: once is not None and doc.get("streams", {}).get(once[0], -1) >= once[1]
        if stored(manifest.load()):
            return False
        known = (self.catalog.schema(database, measurement) or {"fields": {}})["fields"]
        fields = ingest.check_schema(known, df.select(*shape.fields).schema)
        self.catalog.set_schema(database, measurement, fields, list(shape.tags), keep=True)
        df = df.select(shape.time, *shape.tags, *(F.col(f).cast(FIELD_TYPES[fields[f]][0]).alias(f) for f in shape.fields))
        good = df.where((F.col(shape.time) >= 0) & F.col(shape.time).isNotNull())

        def number(doc: dict) -> int:
            doc["batches"] = doc.get("batches", 0) + 1
            return doc["batches"] - 1

        token = uuid.uuid4().hex
        write_points(good, path, shape, self.config.shard_width, manifest.update(number), token)
        parts = found_parts(self.files, path, token, 0)

        def commit(doc: dict) -> bool:
            if stored(doc):
                return False
            if once:
                doc.setdefault("streams", {})[once[0]] = once[1]
            doc.setdefault("parts", []).extend(parts)
            return True

        if not manifest.update(commit):
            self.files.remove(f"{path}/data/batch={token}")
            return False
        return True

    # ---- queries

    def shape(self, database: str, measurement: str) -> Shape:
        schema = self.catalog.schema(database, measurement)
        return Shape(tuple(self.catalog.tags(database, measurement)), tuple(schema["fields"]) if schema else (), ("_batch", "_seq"))

    def table(self, database: str, measurement: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """All stored points of the shards that meet [start, end), with series_key, _batch, _seq and shard_start."""
        self._open()
        schema, width = self.catalog.schema(database, measurement), self.config.shard_width
        parts = self._manifest(database, measurement).load().get("parts", [])
        if width > 0:
            parts = [p for p in parts if (start is None or p["shard"] + width > start) and (end is None or p["shard"] < end)]
        return read_points(self.spark, self._path(database, measurement), self.catalog.tags(database, measurement), schema["fields"] if schema else {}, parts, self.config.skip_unreadable)

    def _matching(self, database: str, measurement: str, start: int, end: int | None, tags: Mapping[str, str] | None) -> tuple[DataFrame, Shape]:
        shape, df, width = self.shape(database, measurement), self.table(database, measurement, start, end), self.config.shard_width
        if width > 0:  # prunes folders; the time range itself prunes row groups
            df = df.where(F.col("shard_start") >= start // width * width)
            if end is not None:
                df = df.where(F.col("shard_start") < end)
        return ranges.matching(df, shape, start, end, tags), shape

    def query(
        self, database: str, measurement: str, start: int, end: int | None = None, tags: Mapping[str, str] | None = None, fields: Sequence[str] = (), offset: int = 0, limit: int = 0, fill: bool = False
    ) -> DataFrame:
        """A lazy range query; an unknown measurement is empty. ``fill``: zeros for missing fields."""
        self._open()
        if not self.catalog.has(database, measurement):
            return self.spark.createDataFrame([], "timestamp bigint")
        df, shape = self._matching(database, measurement, start, end, tags)
        out = ranges.range_query(df, shape, start, end, None, fields, offset, limit)
        if fill:
            kinds = (self.catalog.schema(database, measurement) or {"fields": {}})["fields"]
            out = zero_fill(out, {f: k for f, k in kinds.items() if f in out.columns})
        return out

    def query_range(self, database: str, measurement: str, start: int, end: int, tags: Mapping[str, str] | None = None, fields: Sequence[str] = (), offset: int = 0, limit: int = 0) -> ranges.Response:
        """A page, collected. total_count is rows skipped and returned: a lower bound of all that match."""
        rows = self.query(database, measurement, start, end, tags, fields, offset, limit).collect()
        skipped = offset if rows else 0
        if offset and not rows and self.catalog.has(database, measurement):
            df, _ = self._matching(database, measurement, start, end, tags)
            skipped = df.limit(offset).count()
        return ranges.Response(database, measurement, start, end, rows, skipped + len(rows), 0 < limit <= len(rows))

    def query_iterator(self, database: str, measurement: str, start: int, end: int | None = None, tags: Mapping[str, str] | None = None, fields: Sequence[str] = (), offset: int = 0, limit: int = 0) -> Rows:
        """Rows one by one, with ``seek``; raises where no shard meets the range."""
        if not self.shards_in(database, measurement, start, end):
            raise NotFound("no shards found")
        return Rows(lambda at: self.query(database, measurement, max(start, at), end, tags, fields, offset if at <= start else 0, limit), start)

    def shards(self, database: str, measurement: str) -> list[int]:
        """Starts of the stored shards."""
        self._open()
        return sorted({p["shard"] for p in self._manifest(database, measurement).load().get("parts", [])})

    def shards_in(self, database: str, measurement: str, start: int, end: int | None) -> list[int]:
        if not self.catalog.has(database, measurement):
            return []
        width = max(1, self.config.shard_width)
        return [s for s in self.shards(database, measurement) if s + width > start and (end is None or s < end)]

    def series(self, database: str, measurement: str) -> DataFrame:
        """The series dictionary in order of first ingest."""
        table = self.table(database, measurement).withColumn("_first", F.struct("_batch", "_seq"))
        return series.dictionary(table, self.catalog.tags(database, measurement), "_first")

    # ---- maintenance

    def delete_range(self, database: str, measurement: str, series_key: str, mint: int, maxt: int, now: int | None = None) -> None:
        """Mark a series' points in [mint, maxt] as deleted; a compaction removes them."""
        self._open()
        token = uuid.uuid4().hex
        row = [(series_key, mint, maxt, time.time_ns() if now is None else now)]
        marks = self.spark.createDataFrame(row, "series_key string, mint long, maxt long, deleted long").coalesce(1)
        marks.write.parquet(f"{self._path(database, measurement)}/marks/batch={token}")
        self._manifest(database, measurement).update(lambda doc: doc.setdefault("tombstones", []).append(token))

    def tombstones(self, database: str, measurement: str, tokens: Sequence[str] | None = None) -> DataFrame:
        """The marks of a measurement: series_key, mint, maxt, deleted."""
        tokens = self._manifest(database, measurement).load().get("tombstones", []) if tokens is None else tokens
        ddl = "series_key string, mint long, maxt long, deleted long"
        return self.spark.read.schema(ddl).parquet(*(f"{self._path(database, measurement)}/marks/batch={t}" for t in tokens)) if tokens else self.spark.createDataFrame([], ddl)

    def drop_old_tombstones(self, database: str, measurement: str, now: int, retention: int) -> int:
        """Rewrite the marks without those of at least ``retention`` ns; returns how many are left."""
        manifest, path = self._manifest(database, measurement), self._path(database, measurement)
        tokens = manifest.load().get("tombstones", [])
        if not tokens:
            return 0
        live, token = merge.live_tombstones(self.tombstones(database, measurement, tokens), now, retention), uuid.uuid4().hex
        live.coalesce(1).write.parquet(f"{path}/marks/batch={token}")
        left = self.tombstones(database, measurement, [token]).count()
        manifest.update(lambda doc: doc.update(tombstones=[t for t in doc["tombstones"] if t not in tokens] + [token] * (left > 0)))
        for t in [*tokens, *[token] * (left == 0)]:
            self.files.remove(f"{path}/marks/batch={t}")
        return left

    def _rewrite(self, database: str, measurement: str, parts: list[dict], keep: str, marks: list[str], level: int) -> None:
        """Put one batch in the place of ``parts``, with one row per time and series and the marks applied.

        The new files count from the moment when the manifest says so; what was written or marked
        meanwhile stays.  Fails, changing nothing, where another compaction came first.
        """
        path, manifest, token = self._path(database, measurement), self._manifest(database, measurement), uuid.uuid4().hex
        schema = self.catalog.schema(database, measurement)
        stored = stored_points(self.spark, path, schema_of(self.catalog.tags(database, measurement), schema["fields"] if schema else {}), parts, self.config.skip_unreadable)
        rows = merge.compacted(stored, self.tombstones(database, measurement, marks) if marks else None, keep, ("_batch", "_seq"))
        rewrite_points(rows, path, token, -(-sum(p["size"] for p in parts) // FILE_BYTES))
        made = found_parts(self.files, path, token, level)
        same = lambda p: (p["batch"], p["shard"])
        old = {same(p) for p in parts}

        def commit(doc: dict) -> bool:
            if not old <= {same(p) for p in doc.get("parts", [])}:
                return False
            doc.setdefault("gone", []).extend({"batch": b, "shard": s, "at": time.time_ns()} for b, s in sorted(old))
            doc["parts"] = [p for p in doc["parts"] if same(p) not in old] + made
            doc["tombstones"] = [t for t in doc.get("tombstones", []) if t not in marks]
            return True

        if not manifest.update(commit):
            self.files.remove(f"{path}/data/batch={token}")
            raise Conflict(f"{database}/{measurement} was compacted by someone else")
        for t in marks:
            self.files.remove(f"{path}/marks/batch={t}")
        self.vacuum(database, measurement)

    def compact(self, database: str, measurement: str, keep: str = "first") -> list[int]:
        """Rewrite all shards with one row per time and series and deletes applied; returns the shards."""
        doc = self._manifest(database, measurement).load()
        if parts := doc.get("parts", []):
            self._rewrite(database, measurement, parts, keep, doc.get("tombstones", []), max(p["level"] for p in parts))
        return sorted({p["shard"] for p in parts})

    def compact_levels(self, database: str, measurement: str, keep: str = "first") -> int:
        """Merge the parts of every level that is due into the next, shard by shard, until none is; returns the merges."""
        done = 0
        while True:
            parts = self._manifest(database, measurement).load().get("parts", [])
            plans = [plan for s in sorted({p["shard"] for p in parts}) if (plan := maintenance.plan_level([p for p in parts if p["shard"] == s]))]
            if not plans:
                return done
            for level, chosen in plans:
                self._rewrite(database, measurement, chosen, keep, [], level + 1)
                done += 1

    def vacuum(self, database: str, measurement: str, now: int | None = None) -> int:
        """Remove files that stopped counting at least ``grace`` ago; returns the parts removed."""
        path, now = self._path(database, measurement), time.time_ns() if now is None else now

        def take(doc: dict) -> list[dict]:
            old = [g for g in doc.get("gone", []) if now - g["at"] >= self.config.grace]
            if old:
                doc["gone"] = [g for g in doc["gone"] if g not in old]
            return old

        old = self._manifest(database, measurement).update(take)
        for g in old:
            self.files.remove(f"{path}/data/batch={g['batch']}/shard_start={g['shard']}")
        return len(old)

    def recover(self) -> list[str]:
        """Remove batches that no manifest names and that are older than ``grace``: what a crash between two steps left."""
        removed = []
        for database, own in self.catalog.doc.load().items():
            for measurement in own:
                path, doc = self._path(database, measurement), self._manifest(database, measurement).load()
                named = {p["batch"] for p in [*doc.get("parts", []), *doc.get("gone", [])]} | set(doc.get("tombstones", []))
                for folder in ("data", "marks"):
                    for name in self.files.folders(f"{path}/{folder}"):
                        at = f"{path}/{folder}/{name}"
                        if name.removeprefix("batch=") not in named and time.time_ns() - self.files.changed(at) * 1_000_000 >= self.config.grace:
                            self.files.remove(at)
                            removed.append(at)
        return removed

    def apply_retention(self, database: str, measurement: str, now: int, retention: int | None = None) -> list[int]:
        """Let go of shards that end before now - retention; returns them."""
        keep = next((r for r in (retention, self.catalog.retention(database, measurement), self.config.retention) if r), 0)
        if not keep:
            return []
        width = self.config.shard_width

        def commit(doc: dict) -> list[int]:
            old = [p for p in doc.get("parts", []) if p["shard"] + width < now - keep]
            if old:
                doc["parts"] = [p for p in doc["parts"] if p not in old]
                doc.setdefault("gone", []).extend({"batch": p["batch"], "shard": p["shard"], "at": time.time_ns()} for p in old)
            return sorted({p["shard"] for p in old})

        gone = self._manifest(database, measurement).update(commit)
        self.vacuum(database, measurement)
        return gone

    def maintain(self, now: int | None = None) -> None:
        """One round of upkeep of all measurements: due levels, retention, and files that no longer count."""
        now = time.time_ns() if now is None else now
        for database, own in self.catalog.doc.load().items():
            for measurement in own:
                try:
                    self.compact_levels(database, measurement)
                    self.apply_retention(database, measurement, now)
                    self.vacuum(database, measurement)
                except (Conflict, NotFound):  # another engine was faster; the next round sees its result
                    continue

    def start_maintenance(self, every: float) -> None:
        """Run ``maintain`` every so many seconds until ``close``."""

        def run() -> None:
            while not self._stopping.wait(every):
                self.maintain()

        self._upkeep = threading.Thread(target=run, daemon=True)
        self._upkeep.start()

    def parts(self, database: str, measurement: str) -> DataFrame:
        """Files of a measurement: shard_start, part, size, min_time, max_time, n_rows."""
        df = self.table(database, measurement).select("shard_start", "timestamp", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_size").alias("bytes"))
        return df.groupBy("shard_start", "part").agg(F.max("bytes").alias("size"), F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"), F.count("*").alias("n_rows"))

    def compaction_due(self, database: str, measurement: str, least_parts: int, size_limit: int) -> DataFrame:
        return maintenance.compaction_due(self.parts(database, measurement), least_parts, size_limit)

    def refresh_shards(self, database: str, measurement: str) -> list[dict]:
        """Count every shard in one pass and register what is found."""
        width = max(1, self.config.shard_width)
        counted = shards.shard_stats(self.table(database, measurement).select("timestamp", "series_key"), width, ("series_key",)).collect()  # a row per shard
        self.catalog.replace_shards(
            database, measurement, [{"start": r.shard_start, "end": r.shard_end, "n_points": r.n_points, "min_time": r.min_time, "max_time": r.max_time, "n_series": r.n_series} for r in counted]
        )
        return self.catalog.registered_shards(database, measurement)

    @contextmanager
    def cancellable(self, tag: str) -> Iterator[None]:
        """Jobs started inside carry a tag by which ``cancel`` ends them."""
        self.spark.addTag(tag)
        try:
            yield
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def import_json(self, database: str, measurement: str, path: str, shape: Shape, schema: str) -> None:
        """Append points of JSON lines (a column per tag and field) read with ``schema``, a DDL."""
        self.write_frame(database, measurement, self.spark.read.schema(schema).json(path), shape)

    def flush_all(self) -> None:
        """Nothing is buffered: a write is stored when it returns."""
        self._open()

    def close(self) -> None:
        """End streams and upkeep, and wait for them."""
        self._stopping.set()
        for stream in self.streams:
            stream.stop()
        if self._upkeep:
            self._upkeep.join()
        self.closed = True


class Rows:
    """An iterator over a query's rows in time order that can go to another time."""

    def __init__(self, rows_from, start: int):
        self._from, self._rows = rows_from, rows_from(start).toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        return next(self._rows)

    def seek(self, timestamp: int) -> None:
        """Go on with the first row at or after a time; a scan from there, which skips all earlier files."""
        self._rows = self._from(timestamp).toLocalIterator(prefetchPartitions=True)


def _check(p: Point | None) -> None:
    if p is None:
        raise InvalidPoint("no point")
    if not p.database:
        raise InvalidPoint("empty database")
    if not p.measurement:
        raise InvalidPoint("empty measurement")
    safe_name(p.database), safe_name(p.measurement)
    if p.timestamp < 0:
        raise InvalidPoint("negative timestamp")
    for v in p.fields.values():
        type_name(v)


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(True).alias("healthy"), F.lit(VERSION).alias("version"))
