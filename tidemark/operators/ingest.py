"""Checks and bookkeeping of a write: validation, flush batches, field types, schema changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FieldTypeMismatch, spark_type_name
from .ordinals import with_position

FLUSH_ROWS = 3000


def reject_reason(database: str = "database", measurement: str = "measurement", time: str = "timestamp") -> Column:
    """Why a row is no point; null for a good one."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(empty(database), "empty database")
        .when(empty(measurement), "empty measurement")
        .when(F.col(time).isNull(), "missing timestamp")
        .when(F.col(time) < 0, "negative timestamp")
    )


def validated(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with reject_reason)."""
    marked = df.withColumn("reject_reason", reject_reason(**columns))
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def flush_batches(df: DataFrame, seq: Sequence[str], within: Sequence[str] = ("shard_start",), rows: int = FLUSH_ROWS) -> DataFrame:
    """``df`` with flush_batch, the number of the write buffer (of ``rows`` rows) that holds a row.

    Rows are numbered along ranges of one global order, so a large shard is no single task.
    """
    placed = with_position(df, [*within, *seq], "__place")
    heads = placed.groupBy(*within).agg(F.min("__place").alias("__head"))
    return placed.join(heads, list(within)).withColumn("flush_batch", F.expr(f"(__place - __head) div {rows}")).drop("__place", "__head")


def field_types(df: DataFrame, fields: Mapping[str, str], seq: str) -> DataFrame:
    """field, type, n_values, first_seq: what a write of ``df`` stores of each field (float64 for one without values), in one scan."""
    counts = [c for i, name in enumerate(fields) for c in (F.count(name).alias(f"n{i}"), F.min(F.when(F.col(name).isNotNull(), F.col(seq))).alias(f"s{i}"))]
    one = lambda i, name, kind: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("n_values"), F.col(f"s{i}").alias("first_seq"))
    rows = df.agg(*counts).select(F.explode(F.array(*(one(i, n, k) for i, (n, k) in enumerate(fields.items())))).alias("f"))
    return rows.select("f.field", F.when(F.col("f.n_values") > 0, F.col("f.kind")).otherwise("float64").alias("type"), "f.n_values", "f.first_seq")


def schema_conflicts(versions: DataFrame) -> DataFrame:
    """field, old_type, new_type of fields (version, field, type) that change type from one version to the next."""
    by = Window.partitionBy("field").orderBy("version")
    out = versions.withColumn("old_type", F.lag("type").over(by)).where("old_type <> type")
    return out.select("version", "field", "old_type", F.col("type").alias("new_type"))


def check_schema(known: Mapping[str, str], schema: T.StructType) -> dict[str, str]:
    """Field types after a write with ``schema``; a field whose type changes is refused."""
    out = dict(known)
    for f in schema.fields:
        kind = spark_type_name(f.dataType)
        if out.setdefault(f.name, kind) != kind:
            raise FieldTypeMismatch(f"{f.name} is {out[f.name]}, not {kind}")
    return out
