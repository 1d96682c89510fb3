import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from brute import targets, words
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, rows
from tidemark.llm.hilbert import files_meeting, hilbert_index, hilbert_shards, shard_documents, write_shards
from tidemark.llm.mixing import mix, mixed, shuffled, splitting_tree


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (3, 1), (1, 4)])
def test_curve_visits_each_cell_once_and_steps_to_neighbours(spark, axes, bits):
    cells = list(itertools.product(range(1 << bits), repeat=axes))
    names = [f"a{i}" for i in range(axes)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} long" for n in names)).withColumn("h", hilbert_index(names, bits))
    at = {r.h: tuple(r)[:-1] for r in df.collect()}
    assert sorted(at) == list(range(len(cells)))
    for i in range(1, len(cells)):
        assert sum(abs(x - y) for x, y in zip(at[i - 1], at[i], strict=True)) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(make, odd_rows, law):
    placed = hilbert_shards(make(odd_rows), 16, law).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == Counter((x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in odd_rows)
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sorted((r.curve for r in placed)) == [r.curve for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    if law == "rows":
        assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total, largest = sum(r.size for r in placed), max(r.size for r in placed)
        assert all(sum(r.size for r in own) <= total / 16 + largest for own in by.values())


def test_shard_documents_keeps_rows(make, odd_rows):
    docs = make(odd_rows)
    out = shard_documents(docs, 4)
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter((x[0], x[1], x[3]) for x in odd_rows)
    assert dict(out.dtypes)["shard"] == "int" and out.select("shard", "slot").distinct().count() == len(odd_rows)


def test_files_along_the_curve_are_pruned(spark, make, tmp_path):
    """On every dimension a filter meets fewer files than where rows lie as they came."""
    langs, sources = ["de", "en", "es", "fr"], [f"s{i:02}" for i in range(40)]
    data = [(i, "w " * (1 << (i * 7 % 11)), langs[i * 13 % 4], sources[i * i % 40]) for i in range(800)]
    docs = make(data).drop("shard", "size").withColumn("bytes", F.octet_length("text"))
    write_shards(docs, str(tmp_path / "curve"))
    docs.repartition(16).write.parquet(str(tmp_path / "plain"))
    for column, value in (("lang", "en"), ("source", "s17"), ("bytes", 2048)):
        met = {k: files_meeting(spark.read.parquet(str(tmp_path / k)), column, value, value).first() for k in ("curve", "plain")}
        assert met["plain"].met == 16 and met["curve"].files >= 16
        assert met["curve"].met <= 0.7 * met["curve"].files, (column, met)


def test_names_take_steps_in_order(make):
    placed = hilbert_shards(make([(i, "x", "en", f"s{i:03}") for i in range(100)] + [(100, "x", None, None)]), 4)
    curve = {r.doc_id: r.curve for r in placed.collect()}
    assert curve[100] == curve[0] and len(set(curve.values())) == 32
    assert all((curve[i] == curve[j]) == (i * 32 // 100 == j * 32 // 100) for i in range(0, 100, 7) for j in range(100))


def test_no_rows(make):
    assert hilbert_shards(make([])).count() == 0 and mixed(make([])).count() == 0 and mix(make([])).count() == 0


@pytest.fixture(params=[200_000, 0])
def bounds(request, monkeypatch):
    """Both ways of numbering and joining: small tables at once, and along ranges."""
    for module, name in ((rows, "FEW_ROWS"), (mixing, "BROADCAST_BLOCKS")):
        monkeypatch.setattr(module, name, request.param)


def _key(df):
    return sorted(map(tuple, df.drop("rid").collect()), key=repr)


def test_mix(make, odd_rows, bounds):
    docs = make(odd_rows)
    found = mix(docs, shards=4, blocks_per_shard=8).collect()
    sizes = Counter()
    for x in odd_rows:
        sizes[x[3]] += len(words(x[1]))
    want = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted((x[0] is None, x[0] or 0, len(words(x[1]))) for x in odd_rows)
    taken, partial = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == sum(c.words for c in r.copies) <= 3 * r.size and len({c["pass"] for c in r.copies}) == len(r.copies)
        assert all(0 <= c.shard < 4 and (0 < c.words <= r.size or r.size == 0) for c in r.copies)
        taken[r.source] += r.taken
        partial[r.source] += sum(c.words < r.size for c in r.copies)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items()) and max(partial.values()) <= 1


def test_mix_is_the_same_by_both_ways_and_again(make, odd_rows, monkeypatch):
    docs = make(odd_rows)
    first = _key(mix(docs, shards=4, blocks_per_shard=8))
    monkeypatch.setattr(rows, "FEW_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert _key(mix(docs.repartition(5), shards=4, blocks_per_shard=8)) == first
    assert _key(mix(docs, shards=4, blocks_per_shard=8, seed="other")) != first


def test_seed_decides_what_a_partial_pass_takes(make):
    docs = make([(i, "w " * 10, "en", s) for i, s in enumerate("a" * 30 + "b" * 90 + "c" * 90)])
    taken = [frozenset(r.doc_id for r in mix(docs, seed=str(n)).collect() if r.source == "c" and r.taken == 20) for n in range(3)]
    assert len(set(taken)) == 3


def test_many_sources_share_by_weight(make):
    data = [(i, "w " * (i % 17 + 1), None if i % 11 == 0 else f"{'é' if i % 5 == 0 else 'z'}{i % 7}", f"s{i * i % 13}") for i in range(300)]
    sizes = Counter()
    for x in data:
        sizes[x[3]] += len(words(x[1]))
    assert {r.source: r.target for r in mix(make(data)).collect()} == pytest.approx(targets(sizes))


def test_tree_keeps_counts_and_halves(spark, bounds):
    counts = spark.createDataFrame([("a", 100), ("b", 34), (None, 1), ("c", 0)], "source string, blocks long")
    dealt = splitting_tree(counts, 8).collect()
    of_source, of_shard = Counter(), Counter()
    for r in dealt:
        of_source[r.source] += r.blocks
        of_shard[r.shard] += r.blocks
    assert of_source == {"a": 100, "b": 34, None: 1}
    assert len(of_shard) == 8 and max(of_shard.values()) - min(of_shard.values()) <= 1


def test_tree_counts_follow_the_hypergeometric_law(spark):
    """Of 60 draws of 20 from 30 and 10, the mean and variance of the smaller source's count in the first half."""
    counts = spark.createDataFrame([("a", 30), ("b", 10)], "source string, blocks long")
    found = [sum(r.blocks for r in splitting_tree(counts, 2, str(n)).collect() if r.source == "b" and r.shard == 0) for n in range(60)]
    mean = sum(found) / 60
    variance = sum((x - mean) ** 2 for x in found) / 59
    assert abs(mean - 5) < 0.7 and 0.9 < variance < 3.6  # the law: 5 and 20 * 0.25 * 0.75 * 20 / 39 = 1.92


def test_shards_are_shuffled_within(make, odd_rows):
    out = shuffled(mixed(make(odd_rows), shards=4)).select("mix_shard", "mix_draw", "doc_id").collect()
    assert [(r.mix_shard, r.mix_draw) for r in out] == sorted((r.mix_shard, r.mix_draw) for r in out)
    assert [r.doc_id or 0 for r in out] != sorted(r.doc_id or 0 for r in out)


def test_stage_meets_quotas_to_the_word(spark, make, odd_rows):
    """Also those that end before the middle of a source's only document."""
    long = [(900, " \n" + " ".join(f"w{i}" for i in range(1000)), "en", "a"), *((901 + i, "x y\tz é " * 5, "en", s) for i, s in enumerate("bbbccc"))]
    for data in (long, odd_rows):
        docs = make(data)
        out = corpus_pipeline.mixing(spark, docs, "")
        assert out.columns == docs.columns
        found = mix(docs).collect()
        quota = {r.source: r.quota for r in found}
        want = Counter((r.doc_id, r.source, c.words) for r in found for c in r.copies)
        assert Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect()) == want
        taken, whole = Counter(), Counter((x[0], x[1], x[3]) for x in data)
        cut = Counter()
        for r in out.collect():
            taken[r.source] += len(words(r.text))
            if (r.doc_id, r.text, r.source) not in whole:
                cut[r.source] += 1
                assert r.n_chars == len(r.text) and any(x[0] == r.doc_id and x[1].startswith(r.text) for x in data)
        assert {s: n for s, n in taken.items() if n} == {s: n for s, n in quota.items() if n} and set(cut.values()) <= {1}
