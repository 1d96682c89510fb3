"""Language identification by multilingual mixture inference.

Each learned language is a distribution of letter trigrams (with word edges).  A document's words are
draws from a mixture of languages: expectation-maximisation estimates the proportions from each word's
trigram likelihoods, for nested sets of all sizes (by the proportions over all languages), and the set
with the best likelihood less (languages - 1) / 2 * log(words) is taken.  The prediction is the set's
largest proportion.

The likelihood is concave in the proportions, so its maximum has a bound at every step: iterations end
when it is at most SLACK above what was reached.  The maximum over all languages in turn bounds every
smaller set's, so sizes that can't win any more are left out without a limit on their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: How far below its maximum a log likelihood may be when iterations end.
SLACK = 0.01
UNKNOWN = "und"

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on each letter, the first letter of each word, each word's text."""
    padded = np.insert(_LETTER[data], offsets[1:], 32)
    line = np.concatenate([[32], padded, [32]]).astype(np.uint32)
    code = (line[:-2] * np.uint32(0x9E3779B1) + line[1:-1] * np.uint32(0x85EBCA6B) + line[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    letters = line[1:-1] != 32
    heads = letters & (line[:-2] == 32)
    owner = np.searchsorted(offsets[1:] + np.arange(len(offsets) - 1), np.flatnonzero(heads), side="left")
    return code[letters], np.flatnonzero(heads[letters]), owner


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, data, offsets in tk.chunks(batch.column("text")):
            langs = batch.column("lang").slice(first, len(offsets) - 1).to_pylist()
            code, heads, owner = _trigrams(data, offsets)
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            lengths = np.diff(np.append(heads, len(code)))
            which = np.repeat(number[owner], lengths)
            for i, name in enumerate(names):
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, dtype=np.int64)
                totals[name] += np.bincount(code[which == i], minlength=BUCKETS)
    for name, counts in totals.items():
        spots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(spots)), pa.array(spots.astype(np.int32)), pa.array(counts[spots])], names=["lang", "bucket", "n"])


class Model:
    """Learned languages in code-point order and their log probabilities (BUCKETS x languages)."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs


def learn(labelled: DataFrame) -> Model:
    """Trigram counts of every row of ``labelled`` (text, lang; null in either: left out), summed on executors.

    What reaches the driver is one number per bucket and language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    table = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = table.column("lang").to_pylist()
    names = sorted(set(found))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((BUCKETS, max(1, len(names))))
    if found:
        counts[table.column("bucket").to_numpy(), [place[x] for x in found]] = table.column("n").to_numpy()
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    return Model(names, logs.astype(np.float32))


def _fit(gain: np.ndarray, at: np.ndarray, words: np.ndarray, shares: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``shares`` (texts x languages; 0 stays 0) to within SLACK of the maximum: proportions and log likelihood per text.

    gain: each word's likelihoods over its best one; at: each text's first word; words: its number of
    words.  Texts that have settled leave the iteration.
    """
    out, fit = shares.copy(), np.zeros(len(at))
    live = np.arange(len(at))
    for turn in range(rounds + 1):
        owner = np.repeat(np.arange(len(at)), words)
        mix = np.maximum(np.einsum("ij,ij->i", gain, shares[owner]), 1e-300)
        slope = np.add.reduceat(gain / mix[:, None], at, axis=0) / words[:, None]
        # concave: the maximum lies at most words * (steepest slope - 1) above
        done = words * (np.where(shares > 0, slope, 0).max(axis=1) - 1) < SLACK
        if turn == rounds:
            done[:] = True
        if done.sum() * 5 >= len(done):
            out[live[done]], fit[live[done]] = shares[done], np.add.reduceat(np.log(mix), at)[done]
            left = ~done
            if not left.any():
                break
            gain, shares, slope, words, live = gain[left[owner]], shares[left], slope[left], words[left], live[left]
            at = np.append(0, np.cumsum(words)[:-1])
        shares = shares * slope
    return out, fit


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's best language (index, -1 for none) and its proportion."""
    n, k = len(offsets) - 1, len(model.names)
    best, score = np.full(n, -1), np.zeros(n)
    code, heads, owner = _trigrams(data, offsets)
    if not len(heads) or not k:
        return best, score
    log = np.add.reduceat(model.logs[code].astype(np.float64), heads, axis=0)
    texts, at, words = np.unique(owner, return_index=True, return_counts=True)
    totals = np.add.reduceat(log, at, axis=0)
    top = log.max(axis=1, keepdims=True)
    gain, base = np.exp(log - top), np.add.reduceat(top[:, 0], at)
    single = totals.argmax(axis=1)
    choice, share, value = single.copy(), np.ones(len(texts)), totals[np.arange(len(texts)), single]
    some = np.flatnonzero(base - np.log(words) / 2 > value + 1e-9)  # elsewhere not even a perfect mixture of two would win
    if k > 1 and len(some):
        mark = np.zeros(len(texts), dtype=bool)
        mark[some] = True
        owner = np.repeat(mark, words)
        gain, words = gain[owner], words[some]
        at = np.append(0, np.cumsum(words)[:-1])
        full, most = _fit(gain, at, words, np.full((len(some), k), 1 / k))
        most = base[some] + most + SLACK
        order = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, k + 1):
            may = most - (size - 1) / 2 * np.log(words) > value[some] + 1e-9
            if not may.any():
                break
            own = np.flatnonzero(may)
            part = gain[np.repeat(may, words)]
            start = np.zeros((len(own), k))
            np.put_along_axis(start, order[own, :size], 1 / size, axis=1)
            shares, fit = _fit(part, np.append(0, np.cumsum(words[own])[:-1]), words[own], start)
            penalised = base[some[own]] + fit - (size - 1) / 2 * np.log(words[own])
            better = penalised > value[some[own]] + 1e-9
            rows = some[own[better]]
            lead = shares[better].argmax(axis=1)
            choice[rows], share[rows], value[rows] = lead, shares[better][np.arange(len(rows)), lead], penalised[better]
    best[texts], score[texts] = choice, np.clip(share, 0, 1)
    return best, score


def _no_letter(text: bytes) -> bool:
    return not any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predicted(model: Model):
    names = np.array([*model.names, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            langs, scores = [], []
            for _, data, offsets in tk.chunks(batch.column("text")):
                best, score = infer(model, data, offsets)
                plain = np.zeros(len(data) + 1, dtype=np.int64)  # letters of ASCII settle it; only texts without them are looked through
                np.cumsum((_LETTER[data] != 32) & (data < 128), out=plain[1:])
                for i in np.flatnonzero((best >= 0) & (plain[offsets[1:]] == plain[offsets[:-1]])):
                    if _no_letter(data[offsets[i] : offsets[i + 1]].tobytes()):
                        best[i], score[i] = -1, 0.0
                langs.append(names[best])
                scores.append(score)
            out = batch.drop_columns(["text"])
            yield out.append_column("lang_pred", pa.array(np.concatenate(langs), pa.string())).append_column("score", pa.array(np.concatenate(scores)))

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with text replaced by lang_pred and score (0 to 1); only text is looked at.

    Null text and texts without a letter are ``und`` with score 0, and so is everything when nothing
    was learned; languages of equal proportion go by code point; long texts are taken whole; an empty
    table gives no rows.  Columns named lang_pred or score are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(_predicted(model), schema)


def held_out(remainder: int = 2, parts: int = 4):
    """Whether a row is not learned from, by its doc_id; null doc_id: not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``; columns stay.

    Learns from the labels of the rows that are not held out.  Where there are none (an empty or
    unlabelled table, or no lang column) nothing can be said of languages, and only null texts and texts
    without a letter go.  Repeated rows share their fate; long texts are judged whole.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    model = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", lang.alias("lang")))
    return docs.mapInArrow(_kept(model), docs.schema)


def _kept(model: Model):
    judge = _predicted(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                named = pa.RecordBatch.from_arrays([batch.column("text"), pa.nulls(len(batch))], names=["text", "row"])
                if model.names:
                    langs = pa.chunked_array([x.column("lang_pred") for x in judge(iter([named]))]).combine_chunks()
                    keep = langs.to_numpy(zero_copy_only=False) != UNKNOWN
                else:
                    keep = [t is not None and not _no_letter(t.encode()) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return run
