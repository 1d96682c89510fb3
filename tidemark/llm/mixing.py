"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents stand in a seeded random order and are cut into blocks of whole documents of
near equal words.  A source's quota is its target in words: full passes over the source take every
block, and what is left takes blocks in a permuted order until the quota is met, the last one as far
as needed.  So the permutation decides which documents of a source a partial pass holds.

A multivariate-hypergeometric splitting tree deals the drawn blocks to output shards: its root holds
every source's number of blocks, every node draws half of its blocks without replacement, and the
counts of its sources in the two halves follow that law, down to a count per source and shard.  Those
counts cut each source's permuted blocks into disjoint runs, one per shard, and within a shard
documents are shuffled by a draw of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import matched, placed_within, running_totals, sums_before, text_key
from .store import discard, materialize

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
SEED = "tidemark"
#: Rows of the table of drawn blocks that are sent to every executor; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000


def _lot(seed: str, *parts: str | Column) -> Column:
    """A seeded draw; null has a place of its own."""
    cols = (F.col(p) if isinstance(p, str) else p for p in parts)
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols)))


def _numbered(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, text_key, source, size and each row's first word in all sources' streams."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        source.alias("source"),
        F.expr(f"cast(coalesce(regexp_count(text, '{WORD}'), 0) as bigint)").alias("size"),
    ).withColumn("draw", _lot(seed, "doc_id"))
    order = [F.col("source").asc_nulls_last(), F.col("draw"), F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    return running_totals(slim, order, ["size"])


def source_quotas(numbered: DataFrame, cap: int = 3) -> DataFrame:
    """source, source_size, source_start, target, quota: a stored table of one row per source.

    Sources by code point, null last, weigh 1, 2, 3 and so on again, and share the sum of all sizes;
    a target stops at ``cap`` times its source's size and the rest is shared anew by weight.  The
    common level that this comes to is the largest of those that each prefix of capped sources gives.
    """
    sums = materialize(numbered.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sums")
    named = sums_before(sums, [F.col("source").asc_nulls_last()], ["source_size"])
    named = named.select("source", "source_size", (F.col("position") % 3 + 1).cast("long").alias("weight"), F.col("source_size_before").alias("source_start"))
    named = materialize(named, "mix-weights")
    total, weights = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    roomy = sums_before(named, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], ["source_size", "weight"])
    level = roomy.agg(F.max((F.lit(total).cast("long") - F.col("source_size_before") * cap) / (F.lit(weights).cast("long") - F.col("weight_before")))).first()[0]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level).cast("double")).cast("double")
    quotas = materialize(named.select("source", "source_size", "source_start", target.alias("target"), F.round(target).cast("long").alias("quota")), "mix-quotas")
    discard(sums, named)
    return quotas


def splitting_tree(counts: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """source, shard, blocks: how many of each source's blocks go to each shard.

    counts: source and blocks (long).  Every node of log2(shards) levels halves its blocks: lots are
    drawn for all of them, and the smaller half of the lots goes left.
    """
    level = int(math.log2(shards))
    if 1 << level != shards:
        raise ValueError("shards must be a power of two")
    nodes = counts.where("blocks > 0").select("source", F.expr("explode(sequence(1L, blocks))").alias("ball"), F.lit(0).alias("shard"))
    nodes = materialize(nodes, "mix-balls")
    for depth in range(level):
        lots = [_lot(seed, F.lit(depth), "shard", "source", "ball"), F.col("source").asc_nulls_last(), F.col("ball")]
        halves = placed_within(nodes, ["shard"], lots).select("source", "ball", F.expr("cast(shard * 2 + if((nth + 1) * 2 <= of, 0, 1) as int)").alias("shard"))
        halves = materialize(halves, "mix-balls")
        discard(nodes)
        nodes = halves
    return nodes.groupBy("source", "shard").agg(F.count("*").alias("blocks"))


def drawn_blocks(numbered: DataFrame, quotas: DataFrame, shards: int, blocks_per_shard: int, seed: str = SEED) -> tuple[DataFrame, int]:
    """(source, block, block_start, copies) of the blocks that the mix takes, and the words of a block.

    block_start is the block's first word in its source's stream; copies has a struct of pass, shard
    and words (how many of the block's first words are taken) for each time that it is drawn.  Its rows
    are at most shards * blocks_per_shard more than there are sources.
    """
    words = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    block_words = max(1, math.ceil(words / (shards * blocks_per_shard)))
    blocks = _with_quota(numbered, quotas).where("size > 0").groupBy("source", "source_size", "quota", F.expr(f"at div {block_words}L").alias("block"))
    blocks = materialize(blocks.agg(F.sum("size").alias("words"), F.min("at").alias("block_start")), "mix-blocks")
    by = Window.partitionBy("source").orderBy("lot", "block")  # a source has at most shards * blocks_per_shard blocks and one
    ahead = by.rowsBetween(Window.unboundedPreceding, -1)
    drawn = blocks.withColumn("lot", _lot(seed, "source", "block")).withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    drawn = drawn.withColumn("pass", F.expr("explode(sequence(0L, (quota - 1) div source_size))")) if words else drawn.withColumn("pass", F.lit(0).cast("long"))
    drawn = drawn.withColumn("take", F.expr("least(words, greatest(0L, quota - pass * source_size - before))")).where("take > 0")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("pass", "lot", "block")))
    drawn = materialize(drawn.select("source", "block", "block_start", "pass", "take", "nth"), "mix-drawn")
    counts = splitting_tree(drawn.groupBy("source").agg(F.count("*").alias("blocks")), shards, seed)
    to = F.sum("blocks").over(Window.partitionBy("source").orderBy("shard"))
    runs = counts.withColumn("to", to).select(F.col("source").alias("s"), "shard", (F.col("to") - F.col("blocks")).alias("from"), "to")
    dealt = drawn.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("nth") > F.col("from")) & (F.col("nth") <= F.col("to")))
    copies = F.sort_array(F.collect_list(F.struct(F.col("pass"), F.col("shard"), F.col("take").alias("words"))))
    dealt = materialize(dealt.groupBy("source", "block", "block_start").agg(copies.alias("copies")), "mix-dealt")
    discard(blocks, drawn)
    return dealt, block_words


def _with_quota(numbered: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows with their source's quota and ``at``, their first word in the source's stream."""
    q = quotas.withColumnRenamed("source", "__source")
    q = F.broadcast(q) if q.count() <= BROADCAST_BLOCKS else q
    return numbered.join(q, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("at", F.col("size_before") - F.col("source_start"))


def mix(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 256, cap: int = 3, seed: str = SEED) -> DataFrame:
    """A row per row of docs: rid, doc_id, text_key, source, size, source_size, target, quota, taken, copies.

    copies has a struct of pass, shard and words for each time that the row is drawn: its first
    ``words`` words, all of them but for the document at which its source's quota ends.  taken is their
    sum, at most ``cap`` times the size; a source's sum is its target, rounded.  A row without words is
    drawn once, with its block in the first pass, or where its source has no words to shard 0.

    docs: doc_id, text and, where there, source; null source is a source of its own, the last; null
    text has size 0; long texts are taken whole; repeated rows are rows of their own; equal seeds and
    rows give equal mixes; an empty table gives no rows.
    """
    numbered = _numbered(docs, seed)
    quotas = source_quotas(numbered, cap)
    dealt, block_words = drawn_blocks(numbered, quotas, shards, blocks_per_shard, seed)
    d = dealt.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "block_start", F.col("copies").alias("drawn"))
    d = F.broadcast(d) if dealt.count() <= BROADCAST_BLOCKS else d
    rows = _with_quota(numbered, quotas).withColumn("block", F.expr(f"at div {block_words}L"))
    rows = rows.join(d, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    own = "transform(drawn, c -> named_struct('pass', c.pass, 'shard', c.shard, 'words', greatest(0L, least(size, c.words - (at - block_start)))))"
    blank = "if(source_size = 0, array(named_struct('pass', 0L, 'shard', 0, 'words', 0L)), filter(drawn, c -> c.pass = 0))"
    none = "cast(array() as array<struct<pass: bigint, shard: int, words: bigint>>)"
    copies = F.expr(f"coalesce(if(size = 0, transform({blank}, c -> named_struct('pass', c.pass, 'shard', c.shard, 'words', 0L)), filter({own}, c -> c.words > 0)), {none})")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.expr("aggregate(copies, 0L, (t, c) -> t + c.words)"))
    return rows.select("rid", "doc_id", "text_key", "source", "size", "source_size", "target", "quota", "taken", "copies")


def mixed(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 256, cap: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix deals them: a row for each time that a document is drawn, with ``mix_shard`` and ``mix_draw``.

    Sorting a shard by ``mix_draw`` shuffles it.  Only the document at which a source's quota ends is cut,
    behind its last drawn word; ``n_chars`` follows a cut text.  Columns stay (those of the two
    names are replaced).
    """
    rows = mix(docs, shards, blocks_per_shard, cap, seed)
    both = matched(docs, rows.where("size(copies) > 0"), "copies", "size", "source").withColumn("copy", F.explode("given.copies"))
    space = WORD.replace("^", "").rstrip("+")
    parts = f"split(row.text, '(?<={space})(?!{space})')"  # words with the blanks behind them; blanks in front are one more
    cut = f"regexp_replace(array_join(slice({parts}, 1, cast(copy.words + if(row.text rlike '^{space}', 1, 0) as int)), ''), '{space}+$', '')"
    short = "copy.words < given.size"
    out = both.withColumn("text", F.expr(f"if({short}, {cut}, row.text)"))
    columns = []
    for f in docs.schema.fields:
        if f.name == "text":
            columns.append(F.col("text"))
        elif f.name == "n_chars":
            columns.append(F.when(F.expr(short), F.length("text")).otherwise(F.col("row.n_chars")).cast(f.dataType).alias("n_chars"))
        elif f.name not in ("mix_shard", "mix_draw"):
            columns.append(F.col(f"row.`{f.name}`"))
    draw = _lot(seed, "copy.shard", "copy.pass", "row.doc_id")
    return out.select(*columns, F.col("copy.shard").alias("mix_shard"), draw.alias("mix_draw"))


def shuffled(mix: DataFrame) -> DataFrame:
    """The rows of ``mixed``, each shard in the order of its draws; a shard may span several partitions, in order."""
    return mix.repartitionByRange(F.col("mix_shard"), F.col("mix_draw")).sortWithinPartitions("mix_shard", "mix_draw")
