"""N-gram Jaccard join by parity sketches.

Every distinct word shingle of a text flips one bit of a long bit sketch.  Elements that two sets
share flip the same bits, so the Hamming distance of two sketches is at most the size of the
symmetric difference of the sets, and Jaccard >= p/q bounds that by d = (q-p)(|A|+|B|)/(q+p).

Size bands.  A set of n shingles belongs to band g when n lies in [B_g, B_g+1), B growing by RATIO,
and also to each later band g+i with n >= p/q * B_g+i, whatever p/q.  Any two sets that can link share
the larger one's band, which fixes d.

Pigeonhole.  In a band the sketch has k = d+1 blocks of 1024 bits.  If the distance is at most d < k
then, going round, some block j starts a run whose first l blocks differ in at most l-1 bits, for
every l at once: the block itself is equal, and if it and the next three hold at most three
differing bits, one of the four residue classes (bit number modulo 4) of those three is equal too.
So a block with at least two bits set is one key; a thinner block, which many sets would share, is
keyed with each residue class of the following blocks.  No pair within the bound is missed.

Candidates of one key are not paired with each other as rows.  Each set is first paired with one
key's smallest set; pairs are verified on the full shingle sets and links closed into components.
Keys whose sets then lie in different components are gone through in tiles of bounded size, where
short folded sketches and sizes rule out pairs by the same bound.  The survivors of a tile that span
it (a forest, nearest pairs first) are verified and components closed again; keys with survivors
beyond the forest are gone through anew, at last for every survivor that still joins two components.
Copies never meet: equal shingle sets are one node throughout.

Results: components are those of all pairs with Jaccard >= p/q.  Nodes are 64-bit hashes of shingle
sets; the chance that any two of N different sets share one is about N*N / 2**65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .rows import attach, text_key
from .store import discard, materialize

RATIO = 1.4
BLOCK_BITS = 1024
_BITS = 10
#: Bits per shingle of the folded sketches.
FOLDED_BITS = 2
#: Rows of a key that meet in one task; larger keys are cut into tiles of two such parts.
TILE_ROWS = 1024
#: Per Python worker: distinct sets remembered so that copies emit no second set of keys. Only saves work.
SEEN_LIMIT = 1 << 20
#: Rows (two or four longs) of routes or labels that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROUTES = 1_000_000
#: Pairs that meet with one copy of a text they share.
PARTNERS = 512
#: Bits of the candidate filter sent to executors: a fixed size, whatever the input.
FILTER_BITS = 1 << 23


def band_edges(largest: int) -> np.ndarray:
    """B_0 = 1 < B_1 < ..., beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges, dtype=np.int64)


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An order-free hash of each set of distinct values."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(tk.mix64(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return tk.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def band_keys(values: np.ndarray, bounds: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch keys of each set (flat, and each set's first one)."""
    sizes = np.diff(bounds)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    edges = band_edges(int(sizes.max()))
    tops = [*edges.tolist()]
    while len(tops) < len(edges) + 2 or p * tops[-1] <= q * int(sizes.max()):  # bands that a set may share with larger ones
        tops.append(max(tops[-1] + 1, int(tops[-1] * RATIO)))
    tops = np.array(tops, dtype=np.int64)
    at = np.searchsorted(tops, sizes, side="right") - 1
    sets = np.flatnonzero(sizes > 0)
    unit_set, unit_band, step = [sets], [at[sets]], 1
    while len(more := sets[(at[sets] + step < len(tops) - 1)]) and len(more := more[q * sizes[more] >= p * tops[at[more] + step]]):
        unit_set.append(more)
        unit_band.append(at[more] + step)
        step += 1
    unit_set, unit_band = np.concatenate(unit_set), np.concatenate(unit_band)
    distance = (q - p) * 2 * (tops[unit_band + 1] - 1) // (q + p)
    keep = distance > 0  # else only equal sets link, and those are one node
    unit_set, unit_band, blocks = unit_set[keep], unit_band[keep], distance[keep] + 1
    if not len(unit_set):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    base = np.zeros(len(unit_set) + 1, dtype=np.int64)
    np.cumsum(blocks, out=base[1:])

    # one bit per element, as (unit's first block + block, bit); bits hit an even number of times vanish
    n = sizes[unit_set]
    unit = np.repeat(np.arange(len(unit_set)), n)
    ends = np.cumsum(n)
    h = values[np.repeat(bounds[unit_set] - (ends - n), n) + np.arange(ends[-1])]
    width = (blocks[unit] * BLOCK_BITS).astype(np.uint64)
    bit = (((h >> np.uint64(32)) * width) >> np.uint64(32)).astype(np.int64)
    spot, hits = np.unique(base[unit] * BLOCK_BITS + bit, return_counts=True)
    spot = spot[hits & 1 == 1]

    # XOR of mixed bit numbers by block and residue class: equal exactly when the bits are, but for hash collisions
    total = int(base[-1])
    cell = (spot >> _BITS) * 4 + (spot & 3)
    order = np.argsort(cell, kind="stable")
    cell, mixed = cell[order], tk.mix64((spot[order] & (BLOCK_BITS - 1)).astype(np.uint64) + np.uint64(1))
    parts = np.zeros(total * 4, dtype=np.uint64)
    if len(cell):
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        parts[cell[heads]] = np.bitwise_xor.reduceat(mixed, heads)
    parts = parts.reshape(total, 4)
    weight = np.bincount(spot >> _BITS, minlength=total)
    whole = parts[:, 0] ^ parts[:, 1] ^ parts[:, 2] ^ parts[:, 3]

    owner = np.repeat(np.arange(len(unit_set)), blocks)
    j = np.arange(total) - base[owner]
    label = tk.mix64((unit_band[owner].astype(np.uint64) << np.uint64(40)) + j.astype(np.uint64) + np.uint64(7))
    key = tk.mix64(whole + label)
    thin = np.flatnonzero(weight < 2)
    keys, owners = [key[weight >= 2]], [owner[weight >= 2]]
    if len(thin):
        k = blocks[owner[thin]]
        run = np.minimum(k, 4)
        # k >= 4: four classes; k of 2 or 3 needs as many classes, and merging classes only loosens the key
        classes = np.where(run == 4, 4, run)
        for r in range(4):
            rows = thin[classes > r]
            kk, cc = k[classes > r], classes[classes > r]
            mixture = np.zeros(len(rows), dtype=np.uint64)
            for step in range(1, 4):
                use = step < np.minimum(kk, 4)
                nxt = base[owner[rows]] + (j[rows] + step) % kk
                part = parts[nxt, r].copy()
                last = cc - 1 == r
                for more in range(r + 1, 4):  # the last class takes the residues that are left
                    part = np.where(last, part ^ parts[nxt, more], part)
                mixture = np.where(use, tk.mix64(mixture + part + np.uint64(step)), mixture)
            keys.append(tk.mix64(key[rows] + tk.mix64(mixture + np.uint64(11 + r))))
            owners.append(owner[rows])
    key, owner = np.concatenate(keys), unit_set[np.concatenate(owners)]
    order = np.argsort(owner, kind="stable")
    return key[order], np.searchsorted(owner[order], np.arange(len(bounds)))


def folded_sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketches of the first power of two of at least FOLDED_BITS bits per value: Hamming distance is at most the symmetric difference."""
    out: list[bytes] = []
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(1, FOLDED_BITS * np.diff(bounds)))).astype(np.int64))
    for a in range(0, len(bounds) - 1, 512):
        cut, wide = bounds[a : a + 513], bits[a : a + 512]
        base = np.zeros(len(wide) + 1, dtype=np.int64)
        np.cumsum(wide, out=base[1:])
        row = np.repeat(np.arange(len(wide)), np.diff(cut))
        bit = (values[cut[0] : cut[-1]] >> np.uint64(7)).astype(np.int64) & (wide[row] - 1)
        odd = (np.bincount(base[row] + bit, minlength=base[-1]) & 1).astype(np.uint8)
        packed = np.packbits(odd).tobytes()
        out += [packed[x // 8 : y // 8] for x, y in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
    return out


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to ``size`` bytes: halves XORed, which only lowers distances."""
    out = np.zeros((len(sketches), size // 8), dtype=np.uint64)
    for n, x in enumerate(sketches):
        row = np.frombuffer(x, dtype=np.uint64)
        out[n] = row if len(x) == size else np.bitwise_xor.reduce(row.reshape(-1, size // 8), axis=0)
    return out


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, data, offsets in tk.chunks(batch.column("text")):
        data = tk.lower(data)
        starts, ends, index = tk.words(data, offsets)
        values, bounds = tk.shingles(tk.word_hashes(data, starts, ends), index, words)
        values, bounds = tk.distinct_per_text(values, bounds)
        yield first, values, bounds, set_hashes(values, bounds)


def _noded(words: int):
    """Each row's node, the size of its set and a folded sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds, nodes in _sets(batch, words):
                own = batch.slice(first, len(nodes))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("text_key"), pa.array(np.diff(bounds)), pa.array(nodes.view(np.int64)), pa.array(folded_sketches(values, bounds), pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "node", "sketch"],
                )

    return run


def _keyed(words: int, p: int, q: int):
    """node and keys of each text whose set is new to the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, values, bounds, nodes in _sets(batch, words):
                fresh = np.zeros(len(nodes), dtype=bool)
                for i, x in enumerate(nodes.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > SEEN_LIMIT:
                    seen.clear()
                sizes = np.diff(bounds)
                own = np.repeat(fresh, sizes)
                cut = np.zeros(len(bounds), dtype=np.int64)
                np.cumsum(np.where(fresh, sizes, 0), out=cut[1:])
                keys, at = band_keys(values[own], cut, p, q)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), tk.list_array(keys, at)], names=["node", "keys"])

    return run


def _picked(words: int, wanted: bytes):
    """Deflated texts of the rows (node, doc_id) whose bit is set in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            for first, _, _, nodes in _sets(batch, words):
                own = batch.slice(first, len(nodes))
                slot = _slots(nodes, own.column("doc_id"))
                rows = pa.array(np.flatnonzero((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
                if len(rows):
                    texts = [zlib.compress((t or "").encode(), 6) for t in own.column("text").take(rows).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes.view(np.int64)).take(rows), own.column("doc_id").take(rows), pa.array(texts, pa.binary())], names=["node", "doc_id", "packed"]
                    )

    return run


def _slots(nodes: np.ndarray, ids: pa.Array) -> np.ndarray:
    own = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    return (tk.mix64(nodes + own * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _small(table: DataFrame) -> DataFrame:
    """A broadcast of a stored table of at most BROADCAST_ROUTES rows, else the table as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROUTES else table


def _routed(docs: DataFrame, routes: DataFrame, words: int) -> DataFrame:
    """(node, target, part, packed): the deflated text of a node's representative for each of its routes.

    routes: node, doc_id, target, part.  The texts are read again rather than kept: a bit filter of
    fixed size picks the rows, and the join with ``routes`` removes what the filter lets through.
    """
    wanted = np.zeros(FILTER_BITS, dtype=bool)
    slots = routes.select("node", "doc_id").mapInArrow(_slot_rows, "slot long").distinct()
    for batch in slots.toArrow().to_batches():
        wanted[batch.column("slot").to_numpy()] = True
    found = docs.select("doc_id", "text").mapInArrow(_picked(words, np.packbits(wanted, bitorder="little").tobytes()), "node long, doc_id long, packed binary")
    exact = routes.select(F.col("node").alias("__n"), F.col("doc_id").alias("__d"), "target", "part")
    return found.join(_small(exact), (F.col("node") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select("node", "target", "part", "packed")


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(nodes, batch.column("doc_id"))))], names=["slot"])


def _checked(words: int, p: int, q: int):
    """Of rows (node, target, part, packed), a target's own text first: the pairs whose sets reach Jaccard p/q, by exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, dtype=np.uint64)
        for batch in (x.slice(at, 200) for x in batches for at in range(0, len(x), 200)):
            u, v = [], []
            texts = pa.array([zlib.decompress(t).decode() for t in batch.column("packed").to_pylist()], pa.string())
            for first, values, bounds, _ in _sets(pa.RecordBatch.from_arrays([texts], names=["text"]), words):
                rows = zip(batch.column("node").slice(first, len(bounds) - 1).to_pylist(), batch.column("target").slice(first, len(bounds) - 1).to_pylist(), strict=True)
                for n, (node, target) in enumerate(rows):
                    found = values[bounds[n] : bounds[n + 1]]
                    if node == target:
                        center, own = target, found
                    elif center == target:
                        common = len(np.intersect1d(own, found, assume_unique=True))
                        if q * common >= p * (len(own) + len(found) - common):
                            u.append(target)
                            v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, slim: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """The pairs (u, v) whose sets reach Jaccard p/q.

    One exchange of texts: of a pair the node with fewer pairs goes to the other, which goes to itself,
    once for every PARTNERS of its pairs.
    """
    degree = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
    for side in ("u", "v"):
        pairs = pairs.join(degree.select(F.col("node").alias(side), F.col("count").alias(f"n{side}")), side)
    pairs = pairs.select(F.expr("if(nu >= nv, u, v)").alias("u"), F.expr("if(nu >= nv, v, u)").alias("v"))
    parts = pairs.groupBy("u").agg(F.expr(f"cast(ceil(count(*) / {PARTNERS}) as int)").alias("parts"))
    to_u = pairs.join(parts, "u").select(F.col("v").alias("node"), F.col("u").alias("target"), F.expr("cast(pmod(xxhash64(v), parts) as int)").alias("part"))
    own = parts.select(F.col("u").alias("node"), F.col("u").alias("target"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    routes = to_u.unionAll(own)
    nodes = materialize(routes.select("node").distinct(), "ngram-reps")
    first = slim.join(_small(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    routes = materialize(routes.join(first, "node"), "ngram-routes")
    texts = _routed(docs, routes, words).repartition("target", "part").sortWithinPartitions("target", "part", F.col("node") != F.col("target"))
    links = materialize(texts.mapInArrow(_checked(words, p, q), "u long, v long"), "ngram-links")
    discard(nodes, routes)
    return links


#: Rounds that verify spanning forests, before one that verifies all survivors.
FOREST_ROUNDS = 1


def _forest(tile: np.ndarray, i: np.ndarray, j: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) span their tiles, nearest first."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = np.zeros(len(i), dtype=bool)
    for n in np.lexsort((j, i, away, tile)).tolist():
        a, b = top(int(i[n])), top(int(j[n]))
        if a != b:
            up[a], keep[n] = b, True
    return keep


def _tiles(p: int, q: int, all_pairs: bool):
    """Pairs of a tile that lie in different components and within the sketch and size bounds."""

    def near(group, part, node, component, size, sketch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.arange(len(node))
        for gap in range(1, len(node)):
            at = at[at + gap < len(node)]
            at = at[group[at] == group[at + gap]]
            if not len(at):
                break
            a, b = size[at], size[at + gap]
            use = (component[at] != component[at + gap]) & (node[at] != node[at + gap]) & (q * np.minimum(a, b) >= p * np.maximum(a, b))
            use &= (part[at] != part[at + gap]) | (part[at] < 0)
            i = at[use]
            step = max(1, (1 << 20) // sketch.shape[1])
            for cut in range(0, len(i), step):
                j = i[cut : cut + step]
                away = np.bitwise_count(sketch[j] ^ sketch[j + gap]).sum(axis=1, dtype=np.int64)
                keep = (q + p) * away <= (q - p) * (size[j] + size[j + gap])
                yield j[keep], j[keep] + gap, away[keep]

    def survivors(group, key, part, node, component, size, sketches) -> pa.RecordBatch:
        found = []
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(np.array([len(x) for x in sketches]), heads)  # a tile's sketches are folded to its shortest
        width = np.repeat(least, np.diff(np.append(heads, len(group))))
        for size_of in np.unique(least):
            rows = np.flatnonzero(width == size_of)
            folded = _folded([sketches[r] for r in rows], int(size_of))
            found += [(rows[i], rows[j], away) for i, j, away in near(group[rows], part[rows], node[rows], component[rows], size[rows], folded)]
        i, j, away = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        tile = np.searchsorted(heads, np.arange(len(group)), side="right") - 1
        more = np.zeros(0, dtype=np.int64)
        if not all_pairs and len(i):
            # equal sets of a tile are one node of its forest
            spot = np.unique(np.stack([tile, node]), axis=1, return_inverse=True)[1].reshape(-1)
            keep = _forest(tile[i], spot[i], spot[j], away)
            more, i, j = np.unique(key[i[~keep]]), i[keep], j[keep]
        u, v = node[i], node[j]
        none, blank = [None] * len(more), [None] * len(u)
        columns = [[*np.minimum(u, v).tolist(), *none], [*np.maximum(u, v).tolist(), *none], [*blank, *more.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns(rows: pa.Table) -> tuple:
            number = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            return number("group"), number("key"), number("part"), number("node"), number("component"), number("n_shingles"), rows.column("sketch").to_pylist()

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            group = rows.column("group").to_numpy()
            end = len(group) if last else int(np.searchsorted(group == group[-1], True))  # a group stays whole
            held[:] = rows.slice(end).combine_chunks().to_batches() if end < len(group) else []
            if end:
                yield survivors(*columns(rows.slice(0, end)))

        for batch in batches:
            for at in range(0, len(batch), 20_000):
                held.append(batch.slice(at, 20_000))
                if sum(map(len, held)) >= 40_000:
                    yield from settle(False)
        if held and sum(map(len, held)):
            yield from settle(True)

    return run


def _survivors(keys: DataFrame, labels: DataFrame, sketches: DataFrame, p: int, q: int, all_pairs: bool) -> DataFrame:
    """(u, v, again): pairs u < v that keys in several components still ask about, and the keys to come again.

    keys: key, node, distinct; sketches: node, n_shingles, sketch.
    """
    named = keys.join(_small(labels), "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", "node", "component")
    of_key = Window.partitionBy("key")
    named = named.withColumns({"low": F.min("component").over(of_key), "high": F.max("component").over(of_key), "rows": F.count("*").over(of_key)}).where("low <> high")
    tiled = named.withColumn("parts", F.expr(f"cast(ceil(rows / {TILE_ROWS}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    tiled = tiled.withColumn("other", F.expr("explode(sequence(0, parts - 1))"))
    tiled = tiled.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
        "key",
        # within a part's own tile all pairs count, elsewhere only those of two parts
        F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("part"),
        "node", "component",
    ).join(sketches, "node")
    dealt = tiled.repartition("group").sortWithinPartitions("group", "node")
    return materialize(dealt.mapInArrow(_tiles(p, q, all_pairs), "u long, v long, again long"), "ngram-found")


def _near(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (u, v) that the sketch and size bounds let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            both = zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist(), strict=True)
            folded = ([_folded([x], min(len(a), len(b))) for x in (a, b)] for a, b in both)
            away = np.array([int(np.bitwise_count(a ^ b).sum()) for a, b in folded], dtype=np.int64)
            keep = ((q + p) * away <= (q - p) * (na + nb)) & (q * np.minimum(na, nb) >= p * np.maximum(na, nb))
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    for side in ("u", "v"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def _shared_keys(base: DataFrame) -> DataFrame:
    """key, node, center (the key's smallest node) of the keys that several nodes have."""
    of_key = Window.partitionBy("key")
    rows = base.select("node", F.explode("keys").alias("key")).withColumn("center", F.min("node").over(of_key)).withColumn("top", F.max("node").over(of_key))
    return materialize(rows.where("center <> top").select("key", "node", "center").dropDuplicates(["key", "node"]), "ngram-keys")


def jaccard_components(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), a row per row of ``docs``: near-duplicate groups by shingles.

    docs: doc_id (long) and text; other columns are ignored.  Two texts link when Jaccard of their
    sets of ``words``-word shingles is at least p/q; component_id is the smallest doc_id reachable.
    Null or wordless text: no shingles, linked with nothing, its own doc_id.  Texts of fewer words
    have one shingle, the whole sequence.  A null doc_id still takes part and never names a group
    (null when the group has no other).  Repeated rows give repeated result rows; an empty table
    gives no rows.
    """
    return _components(docs, words, p, q).drop("component")


def _components(docs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """The rows of ``jaccard_components`` with ``component``, the smallest node reachable, which is never null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    base = materialize(docs.mapInArrow(_noded(words), "doc_id long, text_key long, n_shingles long, node long, sketch binary"), "ngram-base")
    slim = materialize(base.select("doc_id", "text_key", "n_shingles", "node"), "ngram-nodes")
    sketches = materialize(base.where("n_shingles > 0").select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "ngram-sketches")

    discard(base)
    shared = _shared_keys(docs.mapInArrow(_keyed(words, p, q), "node long, keys array<long>"))

    # each set against the center that it shares most keys with
    tried = shared.where("node <> center").groupBy("node").agg(F.mode("center", True).alias("u")).select("u", F.col("node").alias("v"))
    tried = materialize(_near(tried, sketches, p, q), "ngram-pairs")
    links = _verified(tried, docs, slim, words, p, q)

    # keys whose sets lie in different components still
    keys = shared.select("key", "node")
    for turn in range(FOREST_ROUNDS + 1):
        labels = materialize(components(links), "ngram-labels")
        found = _survivors(keys, labels, sketches, p, q, turn == FOREST_ROUNDS)
        pairs = found.where("u is not null").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        again = materialize(found.where("again is not null").select(F.col("again").alias("key")).distinct(), "ngram-again")
        tried, links = tried.unionAll(pairs), links.unionAll(_verified(pairs, docs, slim, words, p, q))
        if again.isEmpty():
            break
        keys = materialize(keys.join(again, "key", "left_semi"), "ngram-keys")
    labels = materialize(components(links), "ngram-labels")
    discard(shared, sketches)

    named = slim.join(_small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "ngram-least")  # apart from the join, so that a very large group's rows needn't meet in one task
    return named.join(_small(least), "component", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def one_per_group(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id; columns stay.

    Rows without words are in no group and all stay; of equal doc_ids the smaller text hash stays, of
    equal rows one; a group in which no row has a doc_id goes by its smallest set.
    """
    found = _components(docs, words, p, q)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("set "), F.col("component").cast("string")))
    kept = found.where("n_shingles > 0").groupBy(group.alias("group")).agg(F.min(rank).alias("first")).select("first.doc_id", "first.text_key")
    rest = found.where("n_shingles = 0").select("doc_id", "text_key")
    return attach(docs, kept.unionAll(rest).withColumn("__kept", F.lit(True)), "__kept").drop("__kept")
