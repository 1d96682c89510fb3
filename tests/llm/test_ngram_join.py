import random

import numpy as np
import pytest
from brute import groups

from tidemark.llm import ngram_join, textkit
from tidemark.llm.components import components
from tidemark.llm.ngram_join import band_keys, jaccard_components, one_per_group


def found(docs, *args):
    return sorted((tuple(r) for r in jaccard_components(docs, *args).drop("text_key").collect()), key=repr)


@pytest.mark.parametrize("rule", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_groups_are_those_of_all_pairs(make, odd_rows, rule):
    want = [w if w[1] else (w[0], 0, w[0]) for w in groups([r[:2] for r in odd_rows], *rule)]
    assert found(make(odd_rows), *rule) == sorted(want, key=repr)


def test_dense_groups(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)  # tiles and further rounds on a small input
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
        rows.append((1000 - i, " ".join(t), None, None))
    assert found(make(rows), 4, 85, 100) == sorted(groups([x[:2] for x in rows], 4, 85, 100), key=repr)


@pytest.mark.parametrize("p", [85, 65, 50, 30])
def test_no_pair_within_the_bound_is_missed(p):
    r, rng = random.Random(3), np.random.default_rng(5)
    fresh = lambda n: textkit.mix64(rng.integers(0, 2**63, n).astype(np.uint64))
    tried = 0
    while tried < 400:
        n = r.choice([3, 5, 7, 9, 12, 15, 20, 30, 50, 100, 300])
        a, apart = fresh(n), n * (100 - p) // 100 + 1
        b = np.concatenate([a[r.randint(0, apart) :], fresh(r.randint(0, apart))])
        A, B = set(a.tolist()), set(b.tolist())
        if A == B or 100 * len(A & B) < p * len(A | B):
            continue
        tried += 1
        keys, at = band_keys(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, len(A), len(A) + len(B)]), p, 100)
        assert {*keys[at[0] : at[1]].tolist()} & {*keys[at[1] :].tolist()}


def test_one_per_group(make, odd_rows):
    docs = make(odd_rows)
    kept = one_per_group(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect() if (r.text or "").split() and r.doc_id is not None))
    want = {w[2] for w in groups([r[:2] for r in odd_rows], 4, 85, 100) if w[1] and w[2] is not None}
    assert sorted({*got}) == sorted(want)
    assert sum(not (r.text or "").split() for r in kept.collect()) == sum(not (x[1] or "").split() for x in odd_rows)


def test_one_per_group_without_ids(make):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s"), (None, text + " end", "en", "s"), (None, "an " + text, "en", "s"), (None, "something else " * 3, "en", "s")]
    left = [r.text for r in one_per_group(make(rows), 4, 80, 100).collect()]
    assert len(left) == 2 and "something else " * 3 in left


def test_empty(make):
    assert found(make([])) == [] and one_per_group(make([])).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 50] + [(900, r.randrange(400, 900)) for _ in range(200)] + [(5, 5), (2, 1), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((top(u), top(v)))
            up[b] = a
    assert got == {i: top(i) for i in up}


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """One task settles few edges, without rounds, as the rounds do."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 50] + [(900, i) for i in range(400, 500)] + [(5, 5), (2, 1), (None, 3)], "u long, v long")
    got = {}
    for few in (0, 200_000):
        monkeypatch.setattr("tidemark.llm.components.FEW_ROWS", few)
        spark.sparkContext.setJobGroup(f"edges-{few}", "")
        got[few] = sorted(tuple(r) for r in components(edges).collect())
    assert got[0] == got[200_000] and len(got[0]) > 300
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("edges-200000")) <= 8
    assert components(edges.where("u < 0")).count() == 0
