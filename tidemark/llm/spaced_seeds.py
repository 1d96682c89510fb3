"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask laid over a window of words hashes only the words under a 1, so a substituted word under a 0
leaves the hash as it was.  Hashes of all windows of the benchmark and of the documents are joined;
each hit names an alignment of an item with a document.

Around the hit the overlap is verified word by word: of an alignment, the stretch counts that scores
best when a word in place gives 1 and any other takes GAP.  Inserted or lost words shift what follows
to another alignment, which has a hit of its own; stretches of alignments a few words apart are taken
together.  An item is held when one stretch has STRETCH words in place, so a quote of a part is
enough, or when its stretches have half of its words (SHARE), which finds short items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import text_key
from .store import materialize

#: Of any 15 words with any two substituted, some window of some mask is whole.
MASKS = ("11010111", "1110111")
#: What a word out of place takes from a stretch.
GAP = 2
#: Words in place of one stretch that make an overlap, whatever the item's length.
STRETCH = 13
#: Or this share of an item's words in place, and LEAST_WORDS (or all, of a shorter item), in near stretches.
SHARE = 0.5
LEAST_WORDS = 8
#: Items of fewer words are found only in texts that have no other word: they stand in clean texts by chance.
SHORTEST_ITEM = 5
#: Words by which neighbouring stretches of one item may be shifted against each other.
SHIFT = 8
#: Seed rows of the benchmark that are sent to every executor; a larger benchmark is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: str) -> Column:
    """array<long> of hashes of the lower-cased words of a text column; empty for null or no words."""
    clean = F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(" \t\n\x0b\f\r"))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[\\x20\\x09-\\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: str, masks: tuple[str, ...]) -> Column:
    """Hashes of all windows, mask after mask."""
    parts = []
    for number, mask in enumerate(masks):
        places = ", ".join(f"{hashes}[i + {k}]" for k, bit in enumerate(mask) if bit == "1")
        some = f"transform(sequence(0, size({hashes}) - {len(mask)}), i -> xxhash64({number}, {places}))"
        parts.append(f"if(size({hashes}) >= {len(mask)}, {some}, cast(array() as array<bigint>))")
    return F.expr(f"concat({', '.join(parts)})")


def _place(nth: str, size: str, masks: tuple[str, ...]) -> Column:
    """The first word of the window that stands ``nth`` in ``_seeds``."""
    out, ahead, tests = None, "0", []
    for mask in masks:
        tests.append((ahead, f"greatest(0, {size} - {len(mask) - 1})"))
        ahead = f"({ahead} + greatest(0, {size} - {len(mask) - 1}))"
    for ahead, windows in tests:
        test = f"{nth} < {ahead} + {windows}"
        out = F.when(F.expr(test), F.expr(f"{nth} - {ahead}")) if out is None else out.when(F.expr(test), F.expr(f"{nth} - {ahead}"))
    return out


def _places(first_word: str) -> str:
    """The item's words in place within the best stretch of an alignment, an array<int>; each step is bound once by a lambda."""
    score = f"(greatest(0, x.s) + if(v, 1, -{GAP}))"
    begin = "if(x.s <= 0, x.i, x.a)"
    best = (
        "aggregate(m, named_struct('i', 0, 's', 0, 'a', 0, 'best', 0, 'lo', 0, 'hi', -1), (x, v) -> "
        f"if({score} > x.best, named_struct('i', x.i + 1, 's', {score}, 'a', {begin}, 'best', {score}, 'lo', {begin}, 'hi', x.i), "
        f"named_struct('i', x.i + 1, 's', {score}, 'a', {begin}, 'best', x.best, 'lo', x.lo, 'hi', x.hi)))"
    )
    places = f"transform(array({best}), b -> if(b.hi < 0, cast(array() as array<int>), filter(sequence(b.lo, greatest(b.lo, b.hi)), i -> m[i])))[0]"
    return f"transform(array(transform(ih, (w, i) -> coalesce(get(h, {first_word} + i) = w, false))), m -> {places})[0]"


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_WORDS, stretch: int = STRETCH) -> DataFrame:
    """(text_key, item_id, matched, longest, item_words, first_word): the overlap of each distinct text with each item it holds.

    docs: text; benchmark: item_id and text; other columns are ignored.  matched counts the item's
    words in place in neighbouring stretches (of several places in a text, the one with most), longest
    those of the best single stretch; first_word is where the item begins by that group's first
    alignment, in words from 0 (negative where its beginning is cut off); ties go to the larger longest,
    then to the earlier place.  Null and wordless texts and items match nothing; long texts are taken
    whole; items shorter than the masks are sought whole, those of fewer than SHORTEST_ITEM words only
    in texts without other words; a null item_id is kept as it is; repeated rows give one result; empty
    tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes("text").alias("ih")).where("size(ih) > 0").distinct()
    items = materialize(items, "seed-items")
    shortest = min(map(len, MASKS))
    short = [r[0] for r in items.where(f"size(ih) < {shortest}").select(F.size("ih")).distinct().collect()]  # fewer values than a mask has places
    masks = MASKS + tuple("1" * n for n in sorted(short))
    own = items.select("item_id", F.size("ih").alias("n"), F.posexplode(_seeds("ih", masks)).alias("nth", "seed"))
    own = own.select("item_id", "seed", _place("nth", "n", masks).alias("item_place"), F.when(F.col("n") < SHORTEST_ITEM, F.col("n")).alias("alone"))
    if short:  # a mask of an item's whole length is for items of that length
        own = own.distinct()
    own = materialize(own, "seed-windows")
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own

    texts = docs.select(text_key().alias("text_key"), word_hashes("text").alias("h"))
    windows = texts.select("text_key", F.size("h").alias("n"), F.posexplode(_seeds("h", masks)).alias("nth", "seed"))
    hits = windows.join(own, "seed").where("alone is null or alone = n")
    hits = hits.select("text_key", "item_id", (_place("nth", "n", masks) - F.col("item_place")).alias("first_word")).distinct()
    hits = materialize(hits, "seed-hits")
    wanted = hits.select("text_key").distinct()
    kept = docs.select(text_key().alias("text_key"), "text").join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    placed = hits.join(kept.select("text_key", word_hashes("text").alias("h")), "text_key")
    placed = placed.join(items.select(F.col("item_id").alias("__item"), "ih"), F.col("item_id").eqNullSafe(F.col("__item")))
    # generated rather than projected: a filter on what is generated doesn't work it out a second time
    stretches = placed.select("text_key", "item_id", "first_word", F.size("ih").alias("item_words"), F.explode(F.array(F.expr(_places("first_word")))).alias("places"))
    stretches = stretches.where(f"size(places) >= least({min(m.count('1') for m in MASKS)}, item_words)")
    # alignments of a text with an item in order of place; one that is at most SHIFT words further joins the group before it
    grouped = stretches.groupBy("text_key", "item_id", "item_words").agg(F.array_sort(F.collect_list(F.struct("first_word", "places"))).alias("found"))
    near = f"(x.last is not null and f.first_word - x.last <= {SHIFT})"
    group = f"if({near}, x.first, f.first_word)"
    covered = f"if({near}, array_union(x.covered, f.places), f.places)"
    longest = f"if({near}, greatest(x.longest, size(f.places)), size(f.places))"
    best = (
        "aggregate(found, named_struct('last', cast(null as int), 'first', 0, 'covered', cast(array() as array<int>), 'longest', 0, "
        "'best', named_struct('matched', 0, 'longest', 0, 'back', 0)), (x, f) -> "
        f"named_struct('last', f.first_word, 'first', {group}, 'covered', {covered}, 'longest', {longest}, "
        f"'best', greatest(x.best, named_struct('matched', size({covered}), 'longest', {longest}, 'back', -{group}))), x -> x.best)"
    )
    top = F.expr("array_max(transform(found, f -> size(f.places)))")
    scored = grouped.select("text_key", "item_id", "item_words", top.alias("top"), F.explode(F.array(F.expr(best))).alias("best"))
    half = (F.col("best.matched") >= share * F.col("item_words")) & (F.col("best.matched") >= F.least(F.lit(least), F.col("item_words")))
    return scored.where(half | (F.col("top") >= stretch)).select(
        "text_key", "item_id", F.col("best.matched").alias("matched"), F.col("best.longest").alias("longest"), "item_words", (-F.col("best.back")).alias("first_word")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_WORDS, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, item_id, matched, longest, item_words, first_word) of the documents that hold an item; repeated rows once."""
    found = overlaps(docs, benchmark, share, least, stretch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key")).distinct()
    return rows.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_WORDS, stretch: int = STRETCH) -> DataFrame:
    """``docs`` without the rows whose text holds an item; columns stay."""
    found = overlaps(docs, benchmark, share, least, stretch).select("text_key").distinct()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key().alias("text_key"))
    return keyed.join(found, "text_key", "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
