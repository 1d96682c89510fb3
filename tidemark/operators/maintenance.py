"""Planners over metadata: retention, part overlap and selection, compaction triggers, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
#: The most bytes of levels 0 to 4, and what starts a merge of level 0.
LEVEL_MAX = (10 * MIB, 100 * MIB, 1024 * MIB, 10 * 1024 * MIB, 100 * 1024 * MIB)
LEVEL0_BYTES = 5 * MIB
LEVEL0_PARTS = 10


def expired(shards: DataFrame, now: int, retention: int) -> DataFrame:
    """Shards that end before now - retention."""
    return shards.where(F.col("shard_end") < now - retention)


def retained(shards: DataFrame, now: int, retention: int) -> DataFrame:
    return shards.where(F.col("shard_end") >= now - retention)


def part_ranges(df: DataFrame, part: str = "part", time: str = "timestamp", size: Column | None = None) -> DataFrame:
    """Per part: min_time, max_time, n_rows and, where a size is given, its sum."""
    more = [F.sum(size).cast("long").alias("size")] if size is not None else []
    return df.groupBy(part).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.count("*").alias("n_rows"), *more)


def overlapping_parts(parts: DataFrame, group: str = "level") -> DataFrame:
    """Pairs (part, other) of a group whose closed time ranges meet; each pair once."""
    a = parts.select(group, "part", F.col("min_time").alias("a0"), F.col("max_time").alias("a1"))
    b = parts.select(group, F.col("part").alias("other"), F.col("min_time").alias("b0"), F.col("max_time").alias("b1"))
    return a.join(b, group).where("part < other and a0 <= b1 and b0 <= a1").select(group, "part", "other")


def merge_inputs(parts: DataFrame, level: int) -> DataFrame:
    """Names of the parts of ``level`` and of those of the next level whose ranges meet one of them."""
    own = parts.where(F.col("level") == level)
    below = parts.where(F.col("level") == level + 1)
    span = own.select(F.col("min_time").alias("a0"), F.col("max_time").alias("a1"), F.lit(level + 1).alias("level"))
    hit = below.join(span, "level").where("min_time <= a1 and a0 <= max_time").select("part").distinct()
    return own.select("part").unionByName(hit).distinct()


def level_max(level: Column) -> Column:
    """The most bytes of a level: the fixed ones, then 100 MiB * 10 ** (level - 1)."""
    out = None
    for n, most in enumerate(LEVEL_MAX):
        out = F.when(level == n, F.lit(most).cast("long")) if out is None else out.when(level == n, F.lit(most).cast("long"))
    return out.otherwise((F.lit(100 * MIB) * F.pow(F.lit(10), level - 1)).cast("long"))


def select_parts(parts: DataFrame) -> DataFrame:
    """Parts to merge into the next level: smallest first while their sum is at most half its bound, one at least."""
    by = Window.partitionBy("level").orderBy("size", "part")
    running = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = parts.withColumns({"running": running, "nth": F.row_number().over(by)})
    return out.where((F.col("running") <= F.floor(level_max(F.col("level") + 1) / 2)) | (F.col("nth") == 1)).select("level", "part", "size", F.col("running").cast("long").alias("running"))


def compaction_due(parts: DataFrame, least_parts: int, size_limit: int, group: str = "shard_start") -> DataFrame:
    """Per shard: n_parts, size and whether its parts are many enough and small enough to merge."""
    out = parts.groupBy(group).agg(F.count("*").alias("n_parts"), F.sum("size").cast("long").alias("size"))
    return out.withColumn("due", (F.col("n_parts") >= least_parts) & (F.col("size") < size_limit))


def levels_due(parts: DataFrame, level0_parts: int = LEVEL0_PARTS, level0_bytes: int = LEVEL0_BYTES) -> DataFrame:
    """Per level: n_parts, size and whether it must be merged into the next."""
    out = parts.groupBy("level").agg(F.count("*").alias("n_parts"), F.sum("size").cast("long").alias("size"))
    first = (F.col("n_parts") >= level0_parts) | (F.col("size") >= level0_bytes)
    return out.withColumn("due", F.when(F.col("level") == 0, first).otherwise(F.col("size") >= level_max(F.col("level"))))


def plan_level(parts: list[dict]) -> tuple[int, list[dict]] | None:
    """What to merge next of one shard's parts (level, size, batch): the lowest level that is due and its inputs.

    The same rules as ``levels_due`` and ``select_parts``, over the few entries of a manifest; parts of a
    shard share its time range, so all of the next level's take part.  None where nothing is due.
    """
    most = lambda level: LEVEL_MAX[level] if level < len(LEVEL_MAX) else 100 * MIB * 10 ** (level - 1)
    for level in sorted({p["level"] for p in parts}):
        own = sorted((p for p in parts if p["level"] == level), key=lambda p: (p["size"], p["batch"]))
        size = sum(p["size"] for p in own)
        if (len(own) >= LEVEL0_PARTS or size >= LEVEL0_BYTES) if level == 0 else size >= most(level):
            chosen, total = [], 0
            for p in own:
                total += p["size"]
                if chosen and total > most(level + 1) // 2:
                    break
                chosen.append(p)
            return level, chosen + [p for p in parts if p["level"] == level + 1]
    return None
