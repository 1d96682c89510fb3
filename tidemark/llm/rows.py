"""Global running totals and row identity, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize


def running_totals(df: DataFrame, order: Sequence[Column], totals: Sequence[str]) -> DataFrame:
    """``df`` with ``rid`` (a unique long), ``position`` (global, from 0) and ``<c>_before`` for each total.

    The order is cut into ranges of even row counts by sampling, whatever the keys, so that no hot
    value lands in one task; each range is summed on its own and shifted by the sums of the ranges
    before it, a table of one row per range.  Where the cuts fall doesn't change the result.
    """
    cut = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumns(
        {"seq": (F.row_number().over(own) - 1).cast("long")} | {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long") for c in totals}
    )
    parts = cut.groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(f"{c}_sum") for c in totals))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).cast("long").alias(f"shift_{c}") for c in ["rows", *(f"{c}_sum" for c in totals)]))
    out = inner.join(parts, "part").withColumns(
        {"position": F.col("seq") + F.col("shift_rows"), "rid": F.col("part").cast("long") * (1 << 40) + F.col("seq")}
        | {f"{c}_before": F.col(f"{c}_before") + F.col(f"shift_{c}_sum") for c in totals}
    )
    done = materialize(out.drop("part", "seq", "shift_rows", *(f"shift_{c}_sum" for c in totals)), "totals")
    discard(cut)
    return done


def text_key(text: str = "text") -> Column:
    """A 64-bit hash of a text; null and empty differ."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def matched(docs: DataFrame, decided: DataFrame, *columns: str) -> DataFrame:
    """Two structs, ``row`` with the columns of ``docs`` and ``given`` with ``columns`` of ``decided`` (doc_id, text_key, ...), row for row.

    Rows are told apart by doc_id and text; exact repeats are numbered on both sides, so n equal rows
    meet n decisions once each.  Rows without a decision go.  As the columns of ``docs`` travel inside
    a struct, no name of theirs can clash.
    """
    by = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("lost")]
    same = Window.partitionBy("id", "lost", "key")
    right = decided.select(*by, F.col("text_key").alias("key"), F.struct(*columns).alias("given"))
    right = right.withColumn("nth", F.row_number().over(same.orderBy("given")))
    left = docs.select(*by, text_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = left.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    return left.join(right, ["id", "lost", "key", "nth"]).select("row", "given")


def attach(docs: DataFrame, decided: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` that ``matched`` finds, with ``columns``; columns of these names are replaced."""
    both = matched(docs, decided, *columns)
    return both.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in columns), *(F.col(f"given.{c}") for c in columns))


#: Rows up to which one task may hold them all, as it sorts them.
FEW_ROWS = 200_000


def placed_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], label: str = "placed") -> DataFrame:
    """``df`` with ``nth`` (from 0 in a total order) and ``of`` (rows) of each row in its group.

    A stored frame of at most FEW_ROWS is numbered by a window; a larger one, in which a group may be
    too much for a task, along one global order of even ranges.  Both give the same numbers.
    """
    if df.count() <= FEW_ROWS:
        own = Window.partitionBy(*group)
        return df.withColumns({"nth": (F.row_number().over(own.orderBy(*order)) - 1).cast("long"), "of": F.count("*").over(own)})
    names = [F.col(c).asc_nulls_first() for c in group]
    along = running_totals(df, [*names, *order], [])
    heads = along.groupBy(*group).agg(F.min("position").alias("head"), F.count("*").alias("of")).select(F.struct(*group).alias("group"), "head", "of")
    along = along.withColumn("own", F.struct(*group)).join(heads, F.col("own").eqNullSafe(F.col("group")))
    return along.withColumn("nth", F.col("position") - F.col("head")).drop("own", "group", "head", "position", "rid")


def sums_before(sums: DataFrame, order: Sequence[Column], totals: Sequence[str] = ()) -> DataFrame:
    """A stored frame with position and ``<c>_before`` along an order: by a window where they are few, else by ranges."""
    if sums.count() > FEW_ROWS:
        return running_totals(sums, order, totals).drop("rid")
    along = Window.orderBy(*order)
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({"position": F.row_number().over(along) - 1} | {f"{c}_before": F.coalesce(F.sum(c).over(ahead), F.lit(0)).cast("long") for c in totals})
