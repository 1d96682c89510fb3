"""Connected components of an edge table, on executors only.

Large-star and small-star rounds over (u, v) long pairs, each round written to the shared folder.
A node's smallest neighbour is found by a partial aggregation, so a node with very many neighbours
is no hot group; the driver sees two numbers a round.  Few edges are settled by one task without
rounds, whose exchanges and broadcasts cost the driver threads and compiled code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import FEW_ROWS
from .store import discard, materialize


#: Edges up to which a round's smallest neighbours are sent to every executor; beyond, they are joined by a shuffle.
BROADCAST_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """large: hang every larger neighbour of a node on its smallest one; else the smaller neighbours."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(F.broadcast(least) if few else least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v), by union-find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    edges: columns u, v (long).  Self-loops, repeated and reversed edges are fine; nulls are ignored;
    an empty table gives an empty result.
    """
    now = materialize(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    n = now.count()
    if n <= FEW_ROWS:
        return now.coalesce(1).mapInArrow(_settled, "node long, component long")
    before, few = None, n <= BROADCAST_EDGES  # a round makes no more edges than nodes, twice the edges at most
    for _ in range(rounds):
        step = materialize(_star(_star(now, True, few), False, few), "edges")
        stamp = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = step
        if before == stamp:
            break
        before = stamp
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionAll(labels.select(F.col("component").alias("node"), "component")).distinct()
