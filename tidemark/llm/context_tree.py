"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a node in the context of the 0 to DEPTH bytes
before it.  A node's counts give its Krichevsky-Trofimov estimate, and all prunings of the context
tree are mixed: weighted(node) = (estimate + product of its children's weighted) / 2.  The weights
depend on counts alone, so training is one distributed count of byte sequences, and prediction mixes
the estimates of all depths with their posterior weights.  -log2 of the score is the code length.

No context is left out: the counted sequences are dealt to tasks by the SPLIT bytes before their last,
so that a task holds all nodes below a context of that length; the few nodes above it, bounded by the
256 bytes, are made on the driver.  Each distinct sequence gets its value there once.  The most
frequent ones, HOT_GRAMS at most, travel to the tasks with their values; the others of a document are
joined.

The unigram base scores words: its vocabulary is counted over all training rows and joined back to
the rarer words of documents; the HOT_WORDS most frequent, a table of fixed size, travel to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .store import discard, materialize

DEPTH = 5
#: Sequences whose values travel to the tasks; all others are joined.
HOT_GRAMS = 1 << 20
HOT_WORDS = 1 << 19
#: Slots of the direct look-up of travelling sequences; those that meet a taken slot are searched.
SLOTS = 1 << 22
#: Length of the contexts by which sequences are dealt to tasks, and sequences that a task works on at once (whole contexts).
SPLIT = 2
CHUNK_GRAMS = 100_000
#: Sequences per task when the tree's nodes are made.
TASK_GRAMS = 400_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it (0 before the text, and a 0 after it as its end).

    The byte is the lowest 8 bits, the one before it the next 8.  Also each text's first gram.
    """
    n = len(offsets) - 1
    out = np.arange(n) * (depth + 1) + offsets[:-1] + depth  # place of each text's first byte in the padded line
    line = np.zeros(len(data) + n * (depth + 1), dtype=np.uint64)
    shift = np.repeat(out - offsets[:-1], np.diff(offsets))
    line[np.arange(len(data)) + shift] = tk.lower(data)
    grams = line[depth:].copy()
    for back in range(1, depth + 1):
        grams |= line[depth - back : len(line) - back] << np.uint64(8 * back)
    own = np.ones(len(line) - depth, dtype=bool)
    for pad in range(1, depth + 1):
        own[(out - pad - depth)[out - pad >= depth]] = False
    return grams[own], offsets + np.arange(n + 1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _counted(values_of):
    """Count the uint64 values that ``values_of(data, offsets)`` finds, per partition; in rows held out they count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            apart = [(batch, 1)]
            if "held_out" in batch.schema.names:
                out = batch.column("held_out")
                apart = [(batch.filter(pc.invert(out)), 1), (batch.filter(out), 0)]
            for rows, weight in apart:
                for _, data, offsets in tk.chunks(rows.column("text")):
                    key, n = np.unique(values_of(data, offsets), return_counts=True)
                    keys.append(key)
                    counts.append(n.astype(np.int64) * weight)
                    held += len(key)
                    if held > 3_000_000:
                        key, n = _merged(keys, counts)
                        if len(key) > 1_500_000:  # partial counts are summed later anyway
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
                            key, n = key[:0], n[:0]
                        keys, counts, held = [key], [n], len(key)
        if keys:
            key, n = _merged(keys, counts)
            for at in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 200_000].view(np.int64)), pa.array(n[at : at + 200_000])], names=["key", "n"])

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _nodes(grams: np.ndarray, counts: np.ndarray, levels: Iterable[int] = range(8)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes of sorted sequences of one depth: (context, decisions so far) with zeros and ones."""
    keys, zeros, ones = [], [], []
    context, byte = grams >> np.uint64(8), grams & np.uint64(255)
    for level in levels:
        node = (context << np.uint64(8)) | np.uint64(1 << level) | (byte >> np.uint64(8 - level))
        bit = (byte >> np.uint64(7 - level)) & np.uint64(1)
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        every = np.add.reduceat(counts, heads)
        one = np.add.reduceat(counts * bit.astype(np.int64), heads)
        keys.append(node[heads])
        zeros.append(every - one)
        ones.append(one)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order].astype(np.float64), np.concatenate(ones)[order].astype(np.float64)


class ContextTree:
    """Per depth: sorted node keys, the estimate of a one, the weight of stopping there, and what the node's subtree gives."""

    def __init__(self, by_depth: list[tuple[np.ndarray, np.ndarray]], levels: Iterable[int] = range(8)):
        """by_depth: (sequences, counts) of depth 0, 1, ...; levels: the decisions of a byte whose nodes are made."""
        self.keys, self.one, self.stop, self.weighted, self.levels = [], [], [], [], list(levels)
        top = len(by_depth) - 1
        built = [_nodes(*(lambda o: (g[o], n[o]))(np.argsort(g)), self.levels) if len(g) else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)) for g, n in by_depth]
        self.counts = [(zeros, ones) for _, zeros, ones in built]
        below: np.ndarray | None = None
        for depth in range(top, -1, -1):
            key, zeros, ones = built[depth]
            own = _estimate(zeros, ones)
            if below is None:
                weighted, stop = own, np.ones(len(key))
            else:
                child, z, o = built[depth + 1]
                parent = child & np.uint64((1 << (8 * depth + 8)) - 1)
                at = np.minimum(np.searchsorted(key, parent), max(0, len(key) - 1))
                hit = key[at] == parent if len(key) else np.zeros(len(parent), dtype=bool)
                sums = lambda w: np.bincount(at[hit], weights=w[hit], minlength=len(key))  # noqa: B023, E731
                rest = _estimate(np.maximum(0, zeros - sums(z)), np.maximum(0, ones - sums(o)))  # contexts cut from the model, as one
                weighted = math.log(0.5) + np.logaddexp(own, sums(below) + rest)
                stop = np.exp(math.log(0.5) + own - weighted)
            below = weighted
            self.keys.insert(0, key)
            self.one.insert(0, (ones + 0.5) / (zeros + ones + 1))
            self.stop.insert(0, stop)
            self.weighted.insert(0, weighted)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence's last byte after the others; sums to one over the 256 bytes."""
        total = np.zeros(len(grams))
        byte = grams & np.uint64(255)
        for level in self.levels:
            bit = (byte >> np.uint64(7 - level)) & np.uint64(1) == 1
            mixed = np.full(len(grams), np.nan)
            for depth in range(len(self.keys) - 1, -1, -1):
                key = self.keys[depth]
                if not len(key):
                    continue
                context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
                want = (context << np.uint64(8)) | np.uint64(1 << level) | (byte >> np.uint64(8 - level))
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[at] == want
                one, stop = self.one[depth][at], self.stop[depth][at]
                here = np.where(np.isnan(mixed), one, stop * one + (1 - stop) * mixed)
                mixed = np.where(hit, here, mixed)
            mixed = np.where(np.isnan(mixed), 0.5, mixed)
            total += np.log10(np.where(bit, mixed, 1 - mixed))
        return total


def _trees(grams: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[ContextTree]:
    """The trees of each decision of a byte (they share no node), from whole contexts of some length; shorter ones are partial."""
    seen = counts > 0
    by_depth = [(grams[seen], counts[seen])]
    for d in range(depth - 1, -1, -1):
        by_depth.insert(0, _merged([by_depth[0][0] & np.uint64((1 << (8 * d + 8)) - 1)], [by_depth[0][1]]))
    for level in range(8):
        yield ContextTree(by_depth, [level])


class Crown:
    """The nodes of contexts shorter than those by which sequences are dealt: a bounded table."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, split: int):
        """Sorted nodes of depth ``split`` - 1, with the sums of what their children give."""
        self.keys, self.one, self.stop = [], [], []
        for depth in range(split - 1, -1, -1):
            own = _estimate(zeros, ones)
            weighted = math.log(0.5) + np.logaddexp(own, below)
            self.keys.insert(0, keys)
            self.one.insert(0, (ones + 0.5) / (zeros + ones + 1))
            self.stop.insert(0, np.exp(math.log(0.5) + own - weighted))
            keys, place = np.unique(keys & np.uint64((1 << (8 * depth)) - 1), return_inverse=True)
            zeros, ones, below = (np.bincount(place, weights=w, minlength=len(keys)) for w in (zeros, ones, weighted))

    def complete(self, tree: ContextTree) -> ContextTree:
        """``tree`` with these nodes in place of its partial ones."""
        for depth, (key, one, stop) in enumerate(zip(self.keys, self.one, self.stop, strict=True)):
            tree.keys[depth], tree.one[depth], tree.stop[depth] = key, one, stop
        return tree


def _by_context(work, split: int):
    """Run ``work(grams, counts)`` on whole contexts of ``split`` bytes of rows sorted by these."""
    mask = np.uint64((1 << (8 * split)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            held.append((key, batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(key)
            if size < CHUNK_GRAMS:
                continue
            context = (key >> np.uint64(8)) & mask
            cut = int(np.argmax(context == context[-1])) if len(key) else 0
            if cut == 0:  # the last context may have begun in an earlier batch
                continue
            held[-1] = key[:cut], held[-1][1][:cut]
            rest = key[cut:], batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)[cut:]
            yield from work(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held, size = [rest], len(rest[0])
        if size:
            yield from work(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    return run


def _rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    every = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    for at in range(0, len(every[0]), 200_000):
        yield pa.RecordBatch.from_arrays([c.slice(at, 200_000) for c in every], names=list(columns))


def valued(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, n, value: the log10 probability of each distinct sequence's last byte after the others, by the whole tree.

    grams: key and n, how often training rows hold the sequence; those with n = 0 are valued and teach
    nothing.  The driver receives the nodes of contexts of less than SPLIT bytes.
    """
    spark = grams.sparkSession
    split = min(SPLIT, depth)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-grams.count() // TASK_GRAMS))
    context = F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * split)) - 1)
    dealt = grams.repartition(tasks, context).sortWithinPartitions(context)

    def tops(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for tree in _trees(key, n, depth):
            if not len(tree.keys[split]):
                continue
            parent, place = np.unique(tree.keys[split] & np.uint64((1 << (8 * split)) - 1), return_inverse=True)
            zeros, ones = (np.bincount(place, weights=w) for w in tree.counts[split])
            yield from _rows(key=parent, zeros=zeros, ones=ones, below=np.bincount(place, weights=tree.weighted[split]))

    crown = None
    if split:
        top = dealt.mapInArrow(_by_context(tops, split), "key long, zeros double, ones double, below double")
        top = top.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
        key, zeros, ones, below = (top.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
        order = np.argsort(key)
        crown = Crown(key[order].astype(np.int64).view(np.uint64), zeros[order], ones[order], below[order], split)

    def values(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(key))
        for tree in _trees(key, n, depth):
            total += (crown.complete(tree) if crown else tree).log10(key)
        yield from _rows(key=key, n=n, value=total)

    return dealt.mapInArrow(_by_context(values, split), "key long, n long, value double")


class Scorer:
    """Values of the most frequent sequences, laid out for direct look-up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, depth: int):
        order = np.argsort(keys)
        self.keys, self.values, self.depth = keys[order], values[order], depth
        self.slots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's sum over the sequences held here; the others, and the texts they are of."""
        if self.slots is None:  # made by each worker
            key = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
            value, spot = np.zeros(SLOTS), _spot(self.keys, SLOTS)
            key[spot], value[spot] = self.keys, self.values
            self.slots = key, value
        grams, at = byte_grams(data, offsets, self.depth)
        spot = _spot(grams, SLOTS)
        value = self.slots[1][spot]
        missed = np.flatnonzero(self.slots[0][spot] != grams)
        other = missed
        if len(missed) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, grams[missed]), len(self.keys) - 1)
            hit = self.keys[place] == grams[missed]
            value[missed] = np.where(hit, self.values[place], 0.0)
            other = missed[~hit]
        else:
            value[missed] = 0.0
        sums = np.add.reduceat(value, at[:-1]) if len(at) > 1 else np.zeros(0)
        return sums, grams[other], np.searchsorted(at, other, side="right") - 1


def _spot(grams: np.ndarray, slots: int) -> np.ndarray:
    return ((grams * _SPREAD) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows of ``table`` with the largest ``n``: all from a threshold on, at most ``most`` of them.

    The threshold comes from a histogram of eight steps per doubling, a few hundred rows, so no task
    sorts or gathers the table.
    """
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for r in table.where("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        left -= r.rows
        if left < 0:
            break
        least = r.step
    return table.where(F.lit(False)) if least is None else table.where((F.col("n") > 0) & (step >= least))


def learn(rows: DataFrame, depth: int = DEPTH) -> tuple[Scorer, DataFrame]:
    """The most frequent sequences of ``rows`` (text and held_out) for the tasks, and a stored table of all: key, n, value."""
    grams = rows.select("text", "held_out").mapInArrow(_counted(lambda d, o: byte_grams(d, o, depth)[0]), "key long, n long")
    grams = materialize(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    whole = materialize(valued(grams, depth), "values")
    discard(grams)
    hot = _frequent(whole, HOT_GRAMS).select("key", "value").toArrow()
    return Scorer(hot.column("key").to_numpy().astype(np.int64).view(np.uint64), hot.column("value").to_numpy(), depth), whole


def _word_values(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = tk.lower(data)
    starts, ends, _ = tk.words(data, offsets)
    return tk.word_hashes(data, starts, ends)


_SCORED = "rid long, doc_id long, held_out boolean, n_bytes long, n_words long, known long, logs double, score double, rare array<struct<word: long, n: long>>, rare_grams array<struct<gram: long, n: long>>"


def _listed(who: np.ndarray, what: np.ndarray, texts: int, name: str) -> pa.Array:
    """Per text, the distinct values of ``what`` with how often they occur."""
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    heads = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (what[1:] != what[:-1]))) if len(who) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(who))).astype(np.int64)
    cut = np.searchsorted(who[heads], np.arange(texts + 1))
    fields = [pa.field(name, pa.int64()), pa.field("n", pa.int64())]
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(what[heads].view(np.int64)), pa.array(times)], fields=fields))


def _scored(scorer: Scorer, hot: np.ndarray, hot_log: np.ndarray):
    """hot: sorted hashes of frequent words; hot_log: log10 of their counts plus one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column("text")):
                n = len(offsets) - 1
                score, grams, whose = scorer.scores(data, offsets)
                small = tk.lower(data)
                starts, ends, index = tk.words(small, offsets)
                hashes = tk.word_hashes(small, starts, ends)
                owner = np.repeat(np.arange(n), np.diff(index))
                at = np.minimum(np.searchsorted(hot, hashes), max(0, len(hot) - 1))
                hit = hot[at] == hashes if len(hot) else np.zeros(len(hashes), dtype=bool)
                logs = np.bincount(owner[hit], weights=hot_log[at[hit]], minlength=n) if len(hot) else np.zeros(n)
                known = np.bincount(owner[hit], minlength=n)
                rare, rare_grams = _listed(owner[~hit], hashes[~hit], n, "word"), _listed(whose, grams, n, "gram")
                ids = pa.array(np.arange(row, row + n))
                row += n
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n), pa.array(np.diff(offsets)), pa.array(np.diff(index)), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score), rare, rare_grams],
                    names=["rid", "doc_id", "held_out", "n_bytes", "n_words", "known", "logs", "score", "rare", "rare_grams"],
                )

    return run


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    docs: doc_id and text; other columns are ignored.  Learns from rows for which ``held_out`` is
    false (null counts as false).  Tokens are the lower-cased words and one end; base_score is the
    add-one unigram's log10 probability, score the context tree's, of the lower-cased bytes and an
    end, bits_per_byte its code length over these.  Null text is empty; long texts are
    scored whole; repeated rows are learned as often as they occur and score alike; without training
    rows the tree predicts evenly and no token is known; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    scorer, values = learn(rows, depth)
    words = train.select("text").mapInArrow(_counted(_word_values), "key long, n long")
    words = materialize(words.groupBy("key").agg(F.sum("n").alias("n")), "words")
    texts = train.select(F.lit(1)).count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)
    hot = _frequent(words, HOT_WORDS).toArrow()
    key, count = hot.column("key").to_numpy().astype(np.int64).view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(key)
    scored = materialize(rows.mapInArrow(_scored(scorer, key[order], np.log10(count[order] + 1.0)), _SCORED), "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("key"), F.col("r.n").alias("times"))
    rare = rare.join(words, "key").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("add"))
    other = scored.select("rid", F.explode("rare_grams").alias("r")).select("rid", F.col("r.gram").alias("key"), F.col("r.n").alias("times"))
    other = other.join(values.select("key", "value"), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("value")).alias("other"))
    end_log, end_known = math.log10(texts + 1), int(texts > 0)
    tokens = F.col("n_words") + 1
    size = math.log10(n + v + 1)
    return scored.drop("rare", "rare_grams").join(rare, "rid", "left").join(other, "rid", "left").select(
        "doc_id", "held_out", tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + end_known).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("add", F.lit(0.0)) + end_log - tokens * F.lit(size)).alias("base_score"),
        (F.col("score") + F.coalesce("other", F.lit(0.0))).alias("score"),
        ((F.col("score") + F.coalesce("other", F.lit(0.0))) * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
