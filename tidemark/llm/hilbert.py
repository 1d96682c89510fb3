"""Sharding along a Hilbert curve, with SQL expressions only.

Metadata dimensions (language, source, size) are quantised to 32 steps each: names by their rank in
code-point order, sizes by their logarithm.  The cell's index on the three-dimensional Hilbert curve is
computed in the plan, documents are ordered by it and the order is cut into runs.  Cells that are near on the curve are near in every dimension, so a shard's file covers
narrow ranges of each dimension and a filter on any of them prunes files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import attach, running_totals, sums_before, text_key
from .store import materialize

BITS = 5
#: Names (of languages or sources) whose steps are sent to every executor; more are joined by a shuffle.
BROADCAST_NAMES = 1_000_000


def hilbert_index(axes: Sequence[str], bits: int) -> Column:
    """The Hilbert curve index (long) of SQL expressions with integer values in [0, 2**bits)."""
    n = len(axes)
    steps = ",".join(f"named_struct('q', {1 << b}L, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    swap = "((x[0] ^ x[s.i]) & (s.q - 1))"
    turned = (
        f"aggregate(array({steps}), array({','.join(f'cast({a} as bigint)' for a in axes)}), (x, s) -> "
        "case when x[s.i] & s.q <> 0 then transform(x, (v, j) -> case when j = 0 then v ^ (s.q - 1) else v end) "
        f"else transform(x, (v, j) -> case when j = 0 or j = s.i then v ^ {swap} else v end) end)"
        if bits > 1
        else f"array({','.join(f'cast({a} as bigint)' for a in axes)})"
    )
    gray = f"transform({turned}, (v, j, x) -> v)".replace(", x)", ")") if n == 1 else f"aggregate(sequence(1, {n - 1}), {turned}, (x, i) -> transform(x, (v, j) -> case when j = i then v ^ x[i - 1] else v end))"
    levels = ",".join(f"{1 << b}L" for b in range(bits - 1, 0, -1))
    flips = f"aggregate(array({levels}), 0L, (t, q) -> case when x[{n - 1}] & q <> 0 then t ^ (q - 1) else t end)" if bits > 1 else "0L"
    places = ",".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    return F.expr(f"transform(array({gray}), x -> aggregate(array({places}), 0L, (h, s) -> shiftleft(h, 1) | (shiftright(x[s.i] ^ {flips}, s.b) & 1)))[0]")


def _with_step(docs: DataFrame, column: str, to: str) -> DataFrame:
    """``docs`` with the step of a name: its rank among the names there are, scaled to the steps; null is step 0.

    Up to 32 names have a step each; beyond, neighbours in code-point order share one, so that a step is
    always a range of names.
    """
    names = materialize(docs.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct(), "curve-names")
    n = names.count()
    ranked = sums_before(names, [F.col("name")]).select(F.col("name").alias("__name"), F.expr(f"cast(position * {1 << BITS} div {max(n, 1)} as int)").alias(to))
    out = docs.join(F.broadcast(ranked) if n <= BROADCAST_NAMES else ranked, F.col(column) == F.col("__name"), "left").drop("__name")
    return out.withColumn(to, F.coalesce(to, F.lit(0)))


def _quantised(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, size, text_crc32 and the three axes of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    size = F.octet_length(text).cast("long") + 1
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name("lang"), name("source"))
    slim = _with_step(_with_step(slim, "lang", "axis_lang"), "source", "axis_source")
    return slim.withColumn("axis_size", F.least(F.floor(F.log2(F.col("size").cast("double")) * 1.5), F.lit((1 << BITS) - 1)))


def hilbert_shards(docs: DataFrame, shards: int = 16, law: str = "rows") -> DataFrame:
    """A row per row of ``docs``: doc_id, text_key, size, text_crc32, curve, law, shard, slot, grown_shard.

    docs: doc_id, text and, where there, lang and source; others are ignored.  The order is (curve
    index, text hash, doc_id with null first), so equal texts with equal metadata stand together.
    law ``rows``: counts of shards are at most one apart.  law ``bytes``: a row goes to the shard in
    which the middle of its bytes falls, so sizes are at most one row's size apart at each cut.
    Null lang or source is step 0; null text is empty (size 1, crc 0); repeated rows take slots of
    their own; slot counts a shard's rows from 0; an empty table gives no rows.
    """
    keyed = _quantised(docs).withColumn("curve", hilbert_index(["axis_lang", "axis_source", "axis_size"], BITS))
    order = [F.col("curve"), F.col("text_key"), F.col("doc_id").asc_nulls_first()]
    placed = running_totals(keyed.select("doc_id", "text_key", "size", "text_crc32", "curve"), order, ["size"])
    whole = placed.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))
    placed = placed.crossJoin(F.broadcast(whole))  # one row: the totals
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div n_rows as int)"))
        first = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")
    elif law == "bytes":
        placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * size_before + size) * {shards} div (2 * n_bytes)) as int)"))
        heads = placed.groupBy("shard").agg(F.min("position").alias("head"))
        placed = placed.join(F.broadcast(heads), "shard")  # at most ``shards`` rows
        first = F.col("head")
    else:
        raise ValueError(f"no such law: {law}")
    return placed.select(
        "doc_id", "text_key", "size", "text_crc32", "curve", F.lit(law).alias("law"), "shard",
        (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, law: str = "bytes") -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and ``curve`` (columns of these names are replaced)."""
    return attach(docs, hilbert_shards(docs, shards, law), "shard", "slot", "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16, law: str = "bytes") -> None:
    """``shard_documents`` as Parquet, a folder a shard, rows along the curve; a shard of several tasks is several files."""
    placed = shard_documents(docs, shards, law)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def files_meeting(written: DataFrame, column: str, low, high) -> DataFrame:
    """files and met: how many files a Parquet table has, and in how many of them [low, high] meets the column's range."""
    ranges = written.groupBy("_metadata.file_path").agg(F.min(column).alias("a"), F.max(column).alias("b"))
    met = (F.col("a") <= F.lit(high)) & (F.col("b") >= F.lit(low))
    return ranges.agg(F.count("*").alias("files"), F.coalesce(F.sum(met.cast("long")), F.lit(0)).alias("met"))
