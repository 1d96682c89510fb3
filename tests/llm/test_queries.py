import re
from collections import Counter

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from brute import groups, targets, words
from compare import agree
from test_lines_seeds_pages_vectors import brute_overlaps
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert agree(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_point.queries())


def holds(text, item):
    """Whether brute force finds the item; tried only where six words (or all) are in place in some alignment."""
    t, q = words(text), words(item)
    if not q:
        return False
    places = {}
    for i, w in enumerate(q):
        places.setdefault(w, []).append(i)
    in_place = Counter(at - i for at, w in enumerate(t) for i in places.get(w, ()))
    return max(in_place.values(), default=0) >= min(6, len(q)) and brute_overlaps(text, item) is not None


def test_pipeline(spark, sf_dir, monkeypatch):
    """What each stage keeps is what brute force keeps of the same input."""
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.columns == [*docs.columns, "shard", "slot", "curve"] and 0 < last.count()
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]

    given = {name: frame.select("doc_id", "text", "source").collect() for name, frame in seen.items()}
    kept = [sorted(r.doc_id for r in rows) for rows in given.values()]
    first, second, third, fourth, fifth = given.values()
    assert kept[1] == sorted(r.doc_id for r in first if any(c.isalpha() for c in r.text or ""))
    assert kept[2] == sorted(d for d, n, least in groups([(r.doc_id, r.text) for r in second], 5, 80, 100) if d == least or not n)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert kept[3] == sorted(r.doc_id for r in third if not any(holds(r.text, i) for i in items))
    assert len(kept[0]) > len(kept[2]) > len(kept[3]) > 0

    sizes, taken = Counter(), Counter()
    for r in fourth:
        sizes[r.source] += len(words(r.text))
    for r in fifth:
        taken[r.source] += len(words(r.text))
    assert {*kept[4]} <= {*kept[3]} and max(Counter(kept[4]).values()) <= 3
    assert all(abs(taken[s] - target) <= 0.5 for s, target in targets(sizes).items())

    placed = last.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter((r.doc_id, r.text) for r in fifth)
    slots, filled = {}, Counter()
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
        filled[r.shard] += len((r.text or "").encode()) + 1
    assert all(sorted(own) == [*range(len(own))] for own in slots.values()) and {*slots} <= {*range(16)}
    widest = max(len((r.text or "").encode()) + 1 for r in placed)
    assert all(abs(n - sum(filled.values()) / 16) <= widest + 1 for n in filled.values())


def test_stages_on_odd_rows(spark, sf_dir, make, odd_rows):
    for docs in (make(odd_rows), make([])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
            assert docs.columns[: len(columns)] == columns or name == "sharding"
            assert docs.count() <= 3 * before
