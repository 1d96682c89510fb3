"""Measurements as Parquet, and the test tables as points.

A measurement's files lie in ``data/batch=<token>/shard_start=<start>``, a batch for each write or
compaction.  Which of them count is said by the measurement's manifest, a versioned document with the
parts (batch, shard, level, size), so a write or a swap of files is one new version: readers see all of
it or nothing, and files that no longer count stay until those who may still read them are done.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series_key, shard_start
from ..model import FIELD_TYPES, Shape
from .files import Files

TAG, FIELD = "tag_", "f_"


def schema_of(tags: Sequence[str], fields: dict[str, str]) -> str:
    """DDL of a stored measurement."""
    columns = ["timestamp bigint", *(f"`{TAG}{t}` string" for t in tags), *(f"`{FIELD}{f}` {FIELD_TYPES[k][0].simpleString()}" for f, k in fields.items())]
    return ", ".join([*columns, "series_key string", "_batch bigint", "_seq bigint", "shard_start bigint"])


def part_path(path: str, part: Mapping) -> str:
    return f"{path}/data/batch={part['batch']}/shard_start={part['shard']}"


def write_points(df: DataFrame, path: str, shape: Shape, width: int, number: int, token: str) -> None:
    """Write a frame of points as a batch: sorted by time within files, a folder per shard.

    Ingest order is (_batch, _seq): the write's number, then the row's place in it.  Spark balances the
    exchange by size, so a shard is cut into as many files as its bytes ask for, whatever its series.
    """
    names = [F.col(shape.time).cast("long").alias("timestamp"), *(F.col(t).cast("string").alias(f"{TAG}{t}") for t in shape.tags), *(F.col(f).alias(f"{FIELD}{f}") for f in shape.fields)]
    rows = df.select(*names, series_key(shape.tags).alias("series_key"))
    rows = rows.withColumns({"_batch": F.lit(number).cast("long"), "_seq": F.monotonically_increasing_id(), "shard_start": shard_start("timestamp", width)})
    rows = rows.hint("rebalance", F.col("shard_start")).sortWithinPartitions("shard_start", "timestamp", "_seq")
    rows.write.partitionBy("shard_start").parquet(f"{path}/data/batch={token}")


def rewrite_points(df: DataFrame, path: str, token: str, files: int) -> None:
    """Write stored rows anew as a batch of about ``files`` files that don't overlap in time."""
    rows = df.repartitionByRange(max(1, files), "shard_start", "timestamp").sortWithinPartitions("shard_start", "timestamp", "_batch", "_seq")
    rows.write.partitionBy("shard_start").parquet(f"{path}/data/batch={token}")


def found_parts(files: Files, path: str, token: str, level: int) -> list[dict]:
    """The parts that a written batch has."""
    at = f"{path}/data/batch={token}"
    shards = sorted(int(f.partition("=")[2]) for f in files.folders(at) if f.startswith("shard_start="))
    return [{"batch": token, "shard": s, "level": level, "size": sum(n for _, n in files.sizes(f"{at}/shard_start={s}"))} for s in shards]


def stored_points(spark: SparkSession, path: str, ddl: str | None, parts: Iterable[Mapping], skip_unreadable: bool = False) -> DataFrame:
    """The rows of these parts under their stored names; ddl None takes the files' own schema, as a union."""
    reader = spark.read.option("basePath", f"{path}/data")
    reader = reader.schema(f"{ddl}, batch string") if ddl else reader.option("mergeSchema", True)
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.parquet(*(part_path(path, p) for p in parts)).drop("batch")


def read_points(spark: SparkSession, path: str, tags: Sequence[str], fields: dict[str, str], parts: Sequence[Mapping], skip_unreadable: bool = False) -> DataFrame:
    """A stored measurement with its own column names; without parts it is empty."""
    ddl = schema_of(tags, fields)
    df = stored_points(spark, path, ddl, parts, skip_unreadable) if parts else spark.createDataFrame([], ddl)
    return df.withColumnsRenamed({f"{TAG}{t}": t for t in tags} | {f"{FIELD}{f}": f for f in fields})


EVENTS = Shape(tags=("event_type", "usr"), fields=("value", "event_id", "props", "is_error"))
ORDERS = Shape(tags=("o_orderstatus", "o_orderpriority"), fields=("o_totalprice",), ties=("o_orderkey",))
LINEITEM = Shape(tags=("l_returnflag", "l_linestatus"), fields=("quantity", "price", "discount", "tax"), ties=("l_orderkey", "l_linenumber"))


def _nanos(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def between(df: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Rows whose time may lie in [start, end) ns, by the stored timestamp itself: a filter that reaches the scan.

    Bounds are widened to whole microseconds; the exact range is left to the query.
    """
    kind = df.schema[column].dataType
    stamp = lambda micros: F.timestamp_micros(F.lit(micros).cast("long")).cast(kind)
    if start is not None:
        df = df.where(F.col(column) >= stamp(max(0, start) // 1000))
    if end is not None:
        df = df.where(F.col(column) <= stamp(max(0, end) // 1000))
    return df


def events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = between(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", start, end)
    return df.select(_nanos("ts").alias("timestamp"), "event_type", F.col("user_id").cast("string").alias("usr"), "value", "event_id", "props", (F.col("event_type") == "error").alias("is_error"))


def orders(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = between(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", start, end)
    return df.select(_nanos("o_orderdate").alias("timestamp"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey")


def lineitem(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = between(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", start, end)
    named = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    return df.select(_nanos("l_shipdate").alias("timestamp"), "l_returnflag", "l_linestatus", *(F.col(v).alias(k) for k, v in named.items()), "l_orderkey", "l_linenumber")
