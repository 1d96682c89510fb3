"""Exact top-k inner-product search by dual cover trees.

Vectors become integer vectors floor(scale * x).  The top of the cover is made for the whole table: a
bounded number of rows are centres, each candidate belongs to its nearest one, and a ball's covering
radius is its farthest candidate's distance.  Balls of more than BLOCK_ROWS candidates are cut into
parts.  A part's task builds a cover tree over its candidates and one over each group of queries, and
walks both together.  For nodes with centres a, b and covering radii r, s no pair scores above
<a,b> + |a|s + |b|r + rs; a pair of nodes goes when that is below the worst k-th score of the query
node's queries.  Equal bounds are kept, so ties fall to the smaller id.

A query first meets the ball of the centre that it scores best with, and then, with the k-th score
found there, only those balls whose bound reaches it.  No candidate is left out but by a bound, so
results are exact.  How much that saves depends on the data: clustered vectors are mostly pruned;
vectors spread evenly in many dimensions have no ball that any bound excludes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BLOCK_ROWS = 4_096
QUERY_ROWS = 2_048
LEAF = 48
#: Rows whose distances to the rest are taken at once when a cover is made.
PIVOTS = 64
#: Most balls at the top: their centres travel to every task.
MOST_CENTERS = 4_096


class Node:
    """A ball over rows of a matrix: ``rows`` that are balls of their own (a leaf), or children with their centres stacked, or both."""

    __slots__ = ("center", "norm", "radius", "rows", "children", "centers", "norms", "radii")

    def __init__(self, x: np.ndarray, rows: np.ndarray, center: np.ndarray, radius: float):
        self.center, self.norm, self.radius, self.rows, self.children = center, float(np.linalg.norm(center)), radius, rows, []
        if len(rows) <= LEAF or radius == 0:
            return
        scale, found = radius, []
        while len(found) < 2:  # descend scales until the cover has two balls
            scale /= 2
            found = cover(x, rows, scale)
        self.rows = np.concatenate([rows[:0], *(r for r, _, _ in found if len(r) == 1)])
        self.children = [Node(x, r, x[at], far) for r, at, far in found if len(r) > 1]
        if self.children:
            self.centers = np.stack([c.center for c in self.children])
            self.norms = np.array([c.norm for c in self.children])
            self.radii = np.array([c.radius for c in self.children])

    def all_rows(self) -> np.ndarray:
        return np.concatenate([self.rows, *(c.all_rows() for c in self.children)])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows, a little too large rather than too small."""
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    square = a[:, None] + b[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0) + 1e-12 * (a[:, None] + b[None, :]))


def cover(x: np.ndarray, rows: np.ndarray, scale: float) -> list[tuple[np.ndarray, int, float]]:
    """(rows, centre's row, covering radius) of balls of radius ``scale`` whose centres are more than that apart."""
    out: list[tuple[np.ndarray, int, float]] = []
    rest = rows
    while len(rest):
        ahead = min(PIVOTS, len(rest))
        gap = distances(x[rest[:ahead]], x[rest])
        gap[np.arange(ahead), np.arange(ahead)] = 0.0
        owner = np.full(len(rest), -1)
        for p in range(ahead):
            if owner[p] < 0:
                owner[(owner < 0) & (gap[p] <= scale)] = p
        for p in np.unique(owner[owner >= 0]):
            own = np.flatnonzero(owner == p)
            out.append((rest[own], int(rest[p]), float(gap[p, own].max())))
        rest = rest[owner < 0]
    return out


def tree(x: np.ndarray) -> Node:
    gap = distances(x[:1], x)[0]
    return Node(x, np.arange(len(x)), x[0], float(gap.max()) if len(x) > 1 else 0.0)


class Search:
    """Best ``k`` (score, id) of each query against candidates, both as integer-valued float64 rows.

    floor: scores that each query needs at least.  Where products may pass 2**53 scores are summed as
    Python integers.  ``scored`` counts the pairs whose score was taken.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.x, self.ids, self.q, self.qids, self.k = x, ids, queries, query_ids, k
        most = max(float(np.abs(m).max()) if m.size else 0.0 for m in (x, queries))
        self.whole = x.shape[1] * most * most >= 2**53
        self.score = np.full((len(queries), k), -np.inf, dtype=object if self.whole else np.float64)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.norms = np.linalg.norm(x, axis=1)
        self.seen: dict[int, np.ndarray] = {}
        self.scored = 0

    def run(self, candidates: Node) -> None:
        self.pair(tree(self.q), candidates)

    def need(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1].astype(np.float64), self.floor[rows])

    def worst(self, node: Node) -> float:
        if (rows := self.seen.get(id(node))) is None:
            rows = self.seen[id(node)] = node.all_rows()
        return float(self.need(rows).min())

    @staticmethod
    def bound(norm: float, radius: float, dot: np.ndarray, norms: np.ndarray, radii: np.ndarray | float) -> np.ndarray:
        """Upper bounds of the scores between a ball of queries and balls of candidates, with room for rounding."""
        return dot + norm * radii + norms * radius + radius * radii + 1e-9 * (norm + radius) * (norms + radii) + 1e-6

    def pair(self, a: Node, b: Node) -> None:
        if not a.children:
            self.single(a.rows, b)
            return
        if len(b.rows):
            self.points(a, b, b.rows)
        if not b.children:
            return
        if 2 * a.radius >= b.radius:  # part the queries first: their balls shrink, and each finds its near candidates early
            if len(a.rows):
                self.below(a.rows, b)
            for c in a.children:
                self.pair_if(c, b)
        else:
            self.pair_if(a, b)

    def pair_if(self, a: Node, b: Node) -> None:
        """The children of ``b`` that may hold something for ``a``; its own rows have been seen to."""
        reach = self.bound(a.norm, a.radius, b.centers @ a.center, b.norms, b.radii)
        for i in np.argsort(-reach, kind="stable"):
            if reach[i] < self.worst(a):
                break
            self.pair(a, b.children[i])

    def single(self, qrows: np.ndarray, b: Node) -> None:
        """Queries that are balls of their own against a node of candidates."""
        if len(b.rows):
            self.base(qrows, b.rows)
        if b.children:
            self.below(qrows, b)

    def below(self, qrows: np.ndarray, b: Node) -> None:
        """The same against the children of ``b``: each query's most promising one first, then those that its bound still lets it."""
        norms = np.linalg.norm(self.q[qrows], axis=1)[:, None]
        reach = self.bound(norms, 0.0, self.q[qrows] @ b.centers.T, b.norms[None, :], b.radii[None, :])
        best = reach.argmax(axis=1)
        for i in np.unique(best):
            self.single(qrows[best == i], b.children[i])
        for i in np.argsort(-reach.max(axis=0), kind="stable"):
            left = (best != i) & (reach[:, i] >= self.need(qrows))
            if left.any():
                self.single(qrows[left], b.children[i])

    def points(self, a: Node, b: Node, rows: np.ndarray) -> None:
        """All queries of ``a`` against single candidates of ``b``: by its ball first, then as balls of radius 0."""
        if self.bound(a.norm, a.radius, b.center @ a.center, b.norm, b.radius) < self.worst(a):
            return
        reach = self.bound(a.norm, a.radius, self.x[rows] @ a.center, self.norms[rows], 0.0)
        rows = rows[reach >= self.worst(a)]
        if not len(rows):
            return
        if len(a.rows):
            own = self.bound(np.linalg.norm(self.q[a.rows], axis=1), 0.0, self.q[a.rows] @ b.center, b.norm, b.radius)
            if len(own := a.rows[own >= self.need(a.rows)]):
                self.base(own, rows)
        for c in a.children:
            self.points(c, b, rows)

    def base(self, qrows: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            self.scored += len(qrows) * len(part)
            if self.whole:
                got = np.array([[int(v) for v in r] for r in self.q[qrows]], dtype=object) @ np.array([[int(v) for v in r] for r in self.x[part]], dtype=object).T
            else:
                got = self.q[qrows] @ self.x[part].T
            got[self.qids[qrows][:, None] == self.ids[part][None, :]] = -np.inf
            need = np.where(self.score[qrows, -1] > self.floor[qrows], self.score[qrows, -1], self.floor[qrows]) if not self.whole else self.score[qrows, -1]
            use = np.flatnonzero((got >= need[:, None]).any(axis=0) & (got > -np.inf).any(axis=0))
            if not len(use):
                continue
            score = np.concatenate([self.score[qrows], got[:, use]], axis=1)
            ids = np.concatenate([self.best[qrows], np.broadcast_to(self.ids[part[use]], (len(qrows), len(use)))], axis=1)
            if self.whole:
                order = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k] for s, i in zip(score, ids, strict=True)])  # noqa: B023
            else:
                order = np.lexsort((ids, -score), axis=1)[:, : self.k]
            self.score[qrows] = np.take_along_axis(score, order, axis=1)
            self.best[qrows] = np.take_along_axis(ids, order, axis=1)


def _results(s: Search) -> pa.RecordBatch:
    keep = s.score > -np.inf
    ids = np.broadcast_to(s.qids[:, None], s.score.shape)[keep.astype(bool)]
    low, high = -(1 << 63), (1 << 63) - 1
    score = [min(high, max(low, int(v))) for v in s.score[keep.astype(bool)]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.best[keep.astype(bool)], pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, matrix) of runs of vectors of one length."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    cuts = np.flatnonzero(np.diff(dims)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(dims)], strict=True):
        if a < b:
            d = int(dims[a])
            yield a, b, flat[ends[a] - d : ends[b - 1]].reshape(b - a, d)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index, queries = None, [], None, []

        def search() -> pa.RecordBatch:
            ids, x, root = index
            qids, q, floor = (np.concatenate([p[i] for p in queries]) for i in range(3))
            queries.clear()
            s = Search(x, ids, q, qids, k, floor)
            s.run(root)
            return _results(s)

        for batch in batches:
            ids, kinds, parts, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "kind", "part", "floor"))
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for first, last, x in _vectors(batch):
                inner = [c for c in cuts if first < c < last]
                for a, b in zip([first, *inner], [*inner, last], strict=True):
                    at, own = (int(parts[a]), x.shape[1]), x[a - first : b - first]
                    if at != part:
                        if queries and index:
                            yield search()
                        part, held, index = at, [], None
                        queries.clear()
                    if kinds[a] == 0:
                        held.append((ids[a:b], own))
                        continue
                    if index is None and held:
                        m = np.concatenate([p[1] for p in held])
                        index, held = (np.concatenate([p[0] for p in held]), m, tree(m)), []
                    if index is None:
                        continue
                    for i in range(0, b - a, QUERY_ROWS):
                        queries.append((ids[a:b][i : i + QUERY_ROWS], own[i : i + QUERY_ROWS], floors[a:b][i : i + QUERY_ROWS]))
                        if sum(len(p[0]) for p in queries) >= QUERY_ROWS:
                            yield search()
        if queries and index:
            yield search()

    return run


class Top:
    """The balls of the whole table: centres by vector length, and each ball's radius and parts."""

    def __init__(self, centers: dict[int, np.ndarray], first: dict[int, int]):
        self.centers, self.first = centers, first
        self.radius: dict[int, float] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # ball: (number of its first part, parts)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's ball and its distance to the centre."""
        c, out, far = self.centers[x.shape[1]], [], []
        for at in range(0, len(x), 4096):
            gap = distances(x[at : at + 4096], c)
            out.append(gap.argmin(axis=1))
            far.append(gap.min(axis=1))
        return np.concatenate(out) + self.first[x.shape[1]], np.concatenate(far)


def _balled(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _vectors(batch):
                ball, far = top.nearest(x)
                rows = batch.slice(a, b - a)
                yield rows.append_column("ball", pa.array(ball.astype(np.int32))).append_column("far", pa.array(far))

    return run


def routes(top: Top, q: np.ndarray, floor: np.ndarray, first: bool) -> list[np.ndarray]:
    """The balls that each query visits: the one that it scores best with, or else all others that its bound lets it."""
    base = top.first[q.shape[1]]
    balls = np.array([b for b in range(base, base + len(top.centers[q.shape[1]])) if b in top.radius])
    if not len(balls):
        return [balls] * len(q)
    centers, radii = top.centers[q.shape[1]][balls - base], np.array([top.radius[b] for b in balls])
    dots, norms = q @ centers.T, np.linalg.norm(q, axis=1)
    best = dots.argmax(axis=1)
    if first:
        return [balls[[i]] for i in best]
    reach = Search.bound(0.0, 0.0, dots + norms[:, None] * radii[None, :], 0.0, 0.0) + 1e-9 * norms[:, None] * (np.linalg.norm(centers, axis=1) + radii)[None, :]
    keep = reach >= floor[:, None]
    keep[np.arange(len(q)), best] = False
    return [balls[k] for k in keep]


def _routed(top: Top, first: bool):
    """A row per query and part of a ball that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                for a, b, q in _vectors(batch):
                    floor = batch.column("floor").to_numpy(zero_copy_only=False)[a:b]
                    row, part = [], []
                    for i, balls in enumerate(routes(top, q, floor, first)):
                        for ball in balls.tolist():
                            start, n = top.parts[ball]
                            row += [a + i] * n
                            part += range(start, start + n)
                    for at in range(0, len(row), 10_000):
                        some = batch.take(pa.array(row[at : at + 10_000], pa.int64()))
                        yield some.append_column("part", pa.array(part[at : at + 10_000], pa.int32()))

    return run


def _top_of(base: DataFrame, block_rows: int) -> Top:
    """Centres: of each vector length a share of MOST_CENTERS, rows in the order of a hash."""
    sizes = {r.dim: r["count"] for r in base.groupBy("dim").count().collect()}  # a row per vector length
    total, centers, first, ahead = sum(sizes.values()), {}, {}, 0
    for dim, n in sorted(sizes.items()):
        want = max(1, min(-(-n // block_rows), MOST_CENTERS * n // total))
        found = base.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "vector"), "vec_id").select("vector").limit(want).toArrow()
        centers[dim] = np.array(found.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(want, dim)
        first[dim], ahead = ahead, ahead + want
    return Top(centers, first)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each row whose vec_id is divisible by ``every``.

    vectors: vec_id and embedding; other columns are ignored.  Score is the inner product of
    floor(scale * x); ties go to the smaller vec_id; a query's own vec_id is no candidate; fewer
    candidates give fewer rows.  Rows with a null vec_id, a null vector or a null, NaN or infinite
    component, also one that scaling makes infinite, take no part.  Equal rows count once; where a query's vec_id has several vectors the
    smallest is the query and all are candidates.  Vectors of other lengths don't meet.  Of equal
    vectors the k + 1 smallest vec_ids are kept, as no other can be among the k best.  Scores are exact;
    one beyond 64 bits is given as the nearest long.  An empty table gives no rows.
    """
    # from 2**52 on a double is whole, and floor would not fit a long
    whole = f"if(abs({scale}D * x) < 4503599627370496D, cast(floor({scale}D * x) as double), {scale}D * x)"
    sound = f"vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs({scale}D * x) < double('infinity'))"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    base = base.select("vec_id", F.expr(f"transform(embedding, x -> {whole})").alias("vector"))
    asked = base.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked.select("vec_id", "vector", F.size("vector").alias("dim")), "search-queries")
    same = Window.partitionBy("vector").orderBy("vec_id")
    held = base.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "vector").dropDuplicates(["vector", "vec_id"])
    held = materialize(held.select("vec_id", "vector", F.size("vector").alias("dim")), "search-vectors")
    top = _top_of(held, block_rows)
    balled = materialize(held.mapInArrow(_balled(top), "vec_id long, vector array<double>, dim int, ball int, far double"), "search-balls")
    ahead = 0
    for r in balled.groupBy("ball").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("ball").collect():  # at most MOST_CENTERS rows, and one per length
        top.radius[r.ball], top.parts[r.ball] = r.far, (ahead, -(-r.n // block_rows))
        ahead += top.parts[r.ball][1]
    if not ahead:
        return balled.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = balled.sparkSession.createDataFrame([(b, *p) for b, p in top.parts.items()], "ball int, start int, parts int")
    own = balled.join(F.broadcast(spread), "ball").select(  # a row per ball
        "vec_id", "vector", "dim", F.lit(0).alias("kind"), F.lit(0.0).alias("floor"), F.expr("cast(start + pmod(xxhash64(vec_id, vector), parts) as int)").alias("part")
    )
    found = some = None
    for first in (True, False):
        if first:
            asking = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            worst = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            asking = asked.join(worst, asked["vec_id"] == worst["query_id"], "left")
            asking = asking.select("vec_id", "vector", "dim", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
        routed = asking.select("vec_id", "vector", "dim", "floor").mapInArrow(_routed(top, first), "vec_id long, vector array<double>, dim int, floor double, part int")
        both = own.unionByName(routed.withColumn("kind", F.lit(1))).repartition(max(1, ahead), "part").sortWithinPartitions("part", "dim", "kind", "vec_id")
        some = both.select("part", "dim", "kind", "vec_id", "vector", "floor").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
        some = some.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        if not first:
            some = some.unionByName(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        some = some.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        if first and max(map(len, top.centers.values())) > 1:  # else every query has met its only ball
            found = materialize(some.select("query_id", "vec_id", "score"), "search-first")
        elif first:
            break
    return some.select("query_id", "rank", "vec_id", "score")
