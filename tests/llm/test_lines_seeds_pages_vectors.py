import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from brute import words

from tidemark.llm import spaced_seeds, warc
from tidemark.llm.cover_tree import Search, Top, routes, top_k, tree
from tidemark.llm.line_dedup import PIECES, TOKEN, repeated_passages, repeated_units, without_repeats
from tidemark.llm.spaced_seeds import contaminated, decontaminate
from tidemark.llm.warc import archive_round_trip, capture_index, loser_tree, parse_records, unpacked, url_key, write_archives

# ---- lines


def brute_units(rows, least, by):
    """Each row's (unit, start, stop, normal form), then all listed units with their group's first and size, plainly."""
    every = []
    for _, text in rows:
        own, start = [], 0
        for piece in re.findall(PIECES[by], text or ""):
            if w := words(piece):
                lead, tail = len(piece) - len(piece.lstrip(" \t\n\x0b\x0c\r")), len(piece) - len(piece.rstrip(" \t\n\x0b\x0c\r"))
                own.append((start + lead, start + len(piece) - tail, b" ".join(w), len(w)))
            start += len(piece)
        every.append(own)
    holders = defaultdict(set)
    for nth, own in enumerate(every):
        for _, _, norm, _ in own:
            holders[norm].add(nth)
    groups = defaultdict(list)
    for nth, own in enumerate(every):
        unit = 0
        while unit < len(own):
            end = unit
            while end < len(own) and len(holders[own[end][2]]) > 1:
                end += 1
            if sum(max(n, len(norm.decode()) // 10) for _, _, norm, n in own[unit:end]) >= least:
                for u in range(unit, end):
                    doc_id = rows[nth][0]
                    groups[own[u][2]].append(((doc_id is None, doc_id or 0, u, nth), doc_id, u, own[u][0], own[u][1], nth))
            unit = max(end, unit + 1)
    out, cuts = [], defaultdict(list)
    for own in groups.values():
        if len({x[5] for x in own}) > 1:
            own.sort()
            out += [(d, u, a, b, n == 0, own[0][1], own[0][2], len(own)) for n, (_, d, u, a, b, _) in enumerate(own)]
            for x in own[1:]:
                cuts[x[5]].append(x[3:5])
    texts = []
    for nth, (_, text) in enumerate(rows):
        for a, b in sorted(cuts[nth], reverse=True):
            text = text[:a] + text[b:]
        texts.append(text)
    return Counter(out), Counter((d, t) for (d, _), t in zip(rows, texts, strict=True))


def lined(odd_rows):
    r = random.Random(6)
    lines = [" ".join(r.choice(["Aé", "b", "ça", "D.", "ee"]) for _ in range(r.randint(1, 7))) for _ in range(40)]
    rows = [(i, "\n".join(r.choice(lines) + r.choice(["", " ", "\t", "\n"]) for _ in range(r.randint(0, 6))), "en", "s") for i in range(30)]
    return rows + [rows[4], (3, "x\n" + lines[0], None, None), (None, rows[5][1], None, None), (90, "猫" * 45 + "。new", None, None), (91, "old one。" + "猫" * 45 + "。", None, None), *odd_rows]


@pytest.mark.parametrize(("by", "least"), [("segment", 1), ("segment", 4), ("line", 5), ("paragraph", 3)])
def test_repeated_units(make, odd_rows, by, least):
    rows = lined(odd_rows)
    docs = make(rows)
    want, texts = brute_units([x[:2] for x in rows], least, by)
    got = repeated_units(docs, by, least).collect()
    assert Counter((r.doc_id, r.unit, r.start, r.stop, r.kept, r.kept_doc_id, r.kept_unit, r.copies) for r in got) == want
    assert want
    out = without_repeats(docs, by, least)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == texts


def test_clashing_names_stay(spark):
    text = "one two three. four five six."
    docs = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, None)], "doc_id long, text string, gone int, row string").withColumnsRenamed({"gone": "given"})
    out = without_repeats(docs, least=3)
    assert sorted((r.doc_id, r.text.strip(), r.given, r.row) for r in out.collect() if r.row) == [(1, text, 5, "a")]
    assert out.columns == docs.columns


def brute_passages(rows, least):
    """Listed passages of every row, word by word, and the texts without those that go."""
    own = [[(*m.span(), m[0].encode().lower()) for m in re.finditer(TOKEN, text or "")] for _, text in rows]
    places = defaultdict(list)
    for nth, tokens in enumerate(own):
        for at in range(len(tokens) - least + 1):
            doc_id = rows[nth][0]
            places[tuple(t[2] for t in tokens[at : at + least])].append((doc_id is None, doc_id or 0, at, nth))
    out, texts = [], []
    for nth, (tokens, (doc_id, text)) in enumerate(zip(own, rows, strict=True)):
        found, gone = [], set()
        for at in range(len(tokens) - least + 1):
            held = places[tuple(t[2] for t in tokens[at : at + least])]
            if len({x[3] for x in held}) > 1:
                lost, first_id, first_at, first = min(held)
                if found and found[-1][0] + found[-1][1] == at and found[-1][2:4] == [first, first_at - at]:
                    found[-1][1] += 1
                    found[-1][5] = min(found[-1][5], len(held))
                else:
                    found.append([at, 1, first, first_at - at, None if lost else first_id, len(held)])
        for at, n, first, shift, first_id, many in found:
            start, stop, kept = tokens[at][0], tokens[at + n + least - 2][1], first == nth and shift == 0
            out.append((doc_id, at, start, stop, n + least - 1, kept, first_id, at + shift, many))
            gone |= set() if kept else set(range(start, stop))
        texts.append("".join(c for i, c in enumerate(text) if i not in gone) if text else text)
    return Counter(out), Counter((d, t) for (d, _), t in zip(rows, texts, strict=True))


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_repeated_passages(make, odd_rows, least):
    odd = [x for x in odd_rows if x[0] != 76]  # 60,000 words are much for brute force
    rows = lined(odd) + [(200, "the " + "la " * 40, None, None), (201, "la " * 25 + "end", None, None), (202, "x" * 300, None, None), (203, "y " + "x" * 300, None, None)]
    want, texts = brute_passages([x[:2] for x in rows], least)
    got = repeated_passages(make(rows), least).collect()
    assert Counter((r.doc_id, r.word, r.start, r.stop, r.words, r.kept, r.kept_doc_id, r.kept_word, r.copies) for r in got) == want
    assert any(not x[5] for x in want) and any(x[5] for x in want)
    assert Counter((r.doc_id, r.text) for r in without_repeats(make(rows), "word", least).collect()) == texts


def test_passages_cut_inside_sentences(make):
    """Exactly 51 words in common, without a whole sentence among them, are found; 50 are not, nor are repeated sentences of several rows."""
    said = [f"w{i}" for i in range(51)]
    short = [f"v{i}" for i in range(50)]
    mixed = [" ".join(f"s{k}{i}" for i in range(20)) + "." for k in range(3)]
    rows = [(1, "a b " + " ".join(said) + " c."), (2, "d.\ne " + "\n ".join(said).upper() + " f g."), (3, "h " + " ".join(short) + " i"), (4, "j " + " ".join(short) + " k")]
    rows += [(5, " ".join(mixed)), *((6 + k, mixed[k]) for k in range(3))]
    got = repeated_passages(make([(*x, None, None) for x in rows])).collect()
    assert sorted((r.doc_id, r.word, r.words, r.kept, r.kept_doc_id, r.kept_word, r.copies) for r in got) == [(1, 2, 51, True, 1, 2, 2), (2, 2, 51, False, 1, 2, 2)]


def test_long_passages_and_a_crowded_filter(make, odd_rows, monkeypatch):
    """Long texts are taken whole, and a filter whose bits are nearly all set loses nothing."""
    want = None
    for bits in ((20, 27), (15, 15)):
        monkeypatch.setattr("tidemark.llm.line_dedup.FILTER_BITS", bits)
        long = next(x[1] for x in odd_rows if x[0] == 76)
        got = sorted((r.doc_id, r.word, r.words, r.kept, r.copies) for r in repeated_passages(make([*odd_rows, (300, "one " + long, None, None)])).collect() if r.doc_id in (76, 300))
        want = want or got
        assert got == want == [(76, 0, 60_000, True, 2), (300, 1, 60_000, False, 2)]


def test_no_lines(make):
    assert repeated_units(make([])).count() == 0 and without_repeats(make([])).count() == 0


def test_no_passages(make):
    assert repeated_passages(make([])).count() == 0 and without_repeats(make([]), "word", 51).count() == 0


# ---- seeds


def test_planted_items_are_found(spark, make, odd_rows, monkeypatch):
    r = random.Random(9)
    say = lambda n: [f"q{r.randrange(3000)}" for _ in range(n)]
    items = [say(r.randint(15, 50)) for _ in range(12)] + [["a1", "b2", "c3"], ["a1", "b2", "d4", "e5"]]
    bench = spark.createDataFrame([*((i, " ".join(x), "t") for i, x in enumerate(items)), (90, None, None), (91, " ", None), (None, " ".join(items[0]), None), (3, " ".join(items[3]), None)], "item_id long, text string, seed string")
    rows, want = [], set()
    for n in range(60):
        text, i = say(80), r.randrange(len(items))
        hit = n % 3 > 0
        if hit:
            body = list(items[i])
            for spot in r.sample(range(len(body)), 2 if n % 3 == 2 and len(body) >= 15 else 0):
                body[spot] = "zz"
            at = r.randrange(80)
            text[at:at] = [w.upper() for w in body]
            if len(items[i]) >= spaced_seeds.SHORTEST_ITEM:
                want.add((1000 + n, i))
            if i == 0:
                want.add((1000 + n, None))
        rows.append((1000 + n, " \n".join(text), "en", "s"))
    rows.append((2000, "A1  b2\nc3", "en", "s"))  # a very short item counts where it is the whole text
    want.add((2000, 12))
    docs = make(rows + odd_rows + [rows[1]])
    for bound in (spaced_seeds.BROADCAST_ROWS, 0):
        monkeypatch.setattr(spaced_seeds, "BROADCAST_ROWS", bound)
        got = contaminated(docs, bench).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(x.doc_id for x in clean.collect()) == Counter(x[0] for x in rows + odd_rows if x[0] not in {d for d, _ in want})


def brute_overlaps(text, item):
    """matched, longest, first_word and whether it counts, over every alignment in which a mask fits; None without one."""
    t, q = words(text or ""), words(item or "")
    masks = [*spaced_seeds.MASKS, *(["1" * len(q)] if len(q) < min(map(len, spaced_seeds.MASKS)) else [])]
    found = []
    for first in range(-len(q) + 1, len(t)):
        marks = [0 <= first + i < len(t) and t[first + i] == q[i] for i in range(len(q))]
        if sum(marks) < min(6, len(q)):
            continue
        inside = [0 <= first + i < len(t) for i in range(len(q))]
        fits = any(all(inside[o + k] for k in range(len(m))) and all(marks[o + k] for k, c in enumerate(m) if c == "1") for m in masks for o in range(len(q) - len(m) + 1))
        if not fits or (len(q) < spaced_seeds.SHORTEST_ITEM and len(t) != len(q)):
            continue
        sums = [0, *accumulate(1 if x else -spaced_seeds.GAP for x in marks)]
        scores = [(sums[b + 1] - sums[a], -b, -a) for a in range(len(q)) for b in range(a, len(q)) if marks[a]]
        if scores:
            top = max(s[0] for s in scores)
            hi = min(-b for s, b, _ in scores if s == top)
            lo = max(-a for s, b, a in scores if s == top and -b == hi)
            found.append((first, frozenset(i for i in range(lo, hi + 1) if marks[i])))
    found = [(f, p) for f, p in found if len(p) >= min(6, len(q))]
    groups = []
    for first, places in found:
        if groups and first - groups[-1][-1][0] <= spaced_seeds.SHIFT:
            groups[-1].append((first, places))
        else:
            groups.append([(first, places)])
    tops = []
    for g in groups:
        for n in range(1, len(g) + 1):
            tops.append((len(frozenset().union(*(p for _, p in g[:n]))), max(len(p) for _, p in g[:n]), -g[0][0]))
    if not tops:
        return None
    matched, longest, back = max(tops)
    if max(len(p) for _, p in found) >= spaced_seeds.STRETCH or (2 * matched >= len(q) and matched >= min(spaced_seeds.LEAST_WORDS, len(q))):
        return matched, longest, len(q), -back
    return None


def test_overlaps_are_those_of_brute_force(spark, make, odd_rows):
    r = random.Random(10)
    say = lambda n: [r.choice("the of and to in a is it on by we as".split() + [f"w{i}" for i in range(40)]) for _ in range(n)]
    items = {i: say(n) for i, n in enumerate([70, 45, 45, 30, 20, 15, 12, 8, 6, 5, 4, 1])}
    items[11] = ["the"]
    rows = []
    for n in range(70):
        body = list(items[r.choice(list(items))])
        kind = n % 7
        if kind == 1 and len(body) > 20:  # a part
            size = r.choice([12, 13, 20, min(60, len(body))])
            at = r.randrange(len(body) - size + 1)
            body = body[at : at + size]
        elif kind == 2:  # inserted words
            for at in (2 * len(body) // 3, len(body) // 3):
                body[at:at] = ["zz"] * r.randint(1, 9)
        elif kind == 3:  # a fifth substituted
            body = [w if r.random() > 0.2 else "zz" for w in body]
        elif kind == 4:  # lost words
            del body[len(body) // 2 : len(body) // 2 + 2]
        elif kind == 5:
            body = []
        front, back = say(r.randint(0, 60)), say(r.randint(0, 60))
        rows.append((n, " ".join(front + body + back + (body[: len(body) // 2] if n % 11 == 0 else [])), "en", "s"))
    rows += [(800, "THE", None, None), *odd_rows]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.matched, x.longest, x.item_words, x.first_word) for x in contaminated(make(rows), bench).collect()}
    want = {(d, i): f for d, t, *_ in rows for i, q in items.items() if (f := brute_overlaps(t, " ".join(q)))}
    assert got == want
    assert (800, 11) in got and sum(d < 70 for d, _ in got) > 25


def test_part_shifted_and_thinned_copies_are_found(spark, make):
    r = random.Random(12)
    say = lambda n: [f"q{r.randrange(2000)}" for _ in range(n)]
    long, full = say(200), say(45)
    rows = [(1, long[70:130]), (2, long[:90]), (3, full[:15] + ["x"] + full[15:30] + ["y"] + full[30:]), (4, full[:20] + full[22:]), (5, long[50:60]), (6, say(100))]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(full))], "item_id long, text string")
    got = contaminated(make([(i, " ".join([*say(30), *w, *say(30)]), "en", "s") for i, w in rows]), bench)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_two_substitutions_in_fifteen_words_never_hide_a_seed():
    for bad in ((i, j) for i in range(15) for j in range(i, 15)):
        assert any(all(not (0 <= p - o < len(m) and m[p - o] == "1") for p in bad) for m in spaced_seeds.MASKS for o in range(16 - len(m)))


def test_no_benchmark(spark, make, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(make(odd_rows), none).count() == 0 and decontaminate(make(odd_rows), none).count() == len(odd_rows)
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    assert contaminated(make([]), some).count() == 0


# ---- pages


def test_archives(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 9
    rows = [(5, "http://b.example.net/x?q=1", big), (3, "https://B.example.net:8443/", big), (9, "http://a.example.net/", big), (1, "http://a.example.net/", "small"), (2, None, "small")]
    rows += [(7, "bad\r\nurl", None), (8, "http://[x", ""), (None, "http://c/", big), (None, None, None), (3, "http://a/", big), (11, "http://a/", big[:-1])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first long")
    got = archive_round_trip(pages).collect()

    def want(page_id, html):
        data = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        first = min(same) if len(data) >= 100 else None
        revisit = first is not None and (page_id is None or page_id > first)
        return page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want(i, h) for i, _, h in rows)
    assert [r.urlkey for r in got] == sorted(r.urlkey for r in got)
    assert archive_round_trip(pages.limit(0)).count() == 0
    write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert sum(1 for _ in parse_records(data)) == len(rows)
    with pytest.raises(ValueError):
        list(parse_records(data[:-30]))


def test_members_and_ranges(spark, tmp_path, monkeypatch):
    """An archive of one gzip member a record is read whole, as is a plain one; ranges cut one URL's captures in order."""
    import gzip

    pages = spark.createDataFrame([(i, "http://a/" if i % 3 else f"http://b{i}/", f"page {i} " * 20) for i in range(300)], "page_id long, url string, html string")
    write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    starts = [at for at, _, _ in parse_records(data)] + [len(data)]
    members = [gzip.compress(data[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0.gz").write_bytes(b"".join(members[:200]))
    (tmp_path / "m" / "part-1").write_bytes(data[starts[200] :])
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    got = [(r.urlkey, r.captured, r.page_id) for r in capture_index(spark, f"file://{tmp_path}/m").collect()]
    assert got == sorted(got) and sorted(x[2] for x in got) == list(range(300))
    with pytest.raises(ValueError):
        unpacked(members[0] + members[1][:-9])


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(30))) for i in range(k)]
        assert list(loser_tree(runs, key=lambda x: x)) == sorted(x for run in runs for x in run)
    assert url_key("http://www.Example.net/A?b=C") == "net,example,www)/a?b=c" and url_key(None) == ""


# ---- vectors


def brute_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = list({(i, tuple(v)) for i, v in ok})
    out = []
    for i in {i for i, _ in ok if i % 50 == 0}:
        q = min(v for j, v in ok if j == i)
        best = {}
        for j, v in ok:
            if j != i and len(v) == len(q):
                best[j] = max(best.get(j, -(10**18)), sum(a * b for a, b in zip(q, v, strict=True)))
        for rank, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((i, rank, j, int(s)))
    return sorted(out)


@pytest.mark.parametrize("block", [64, 100_000])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 12))
    x = (centers[rng.integers(0, 8, 700)] + 0.1 * rng.normal(size=(700, 12))).astype(np.float32)
    x[200:400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(800, None), (850, [1.0, None] + [0.0] * 10), (900, [float("nan")] * 12), (950, [float("inf")] * 12), (None, x[1].tolist()), rows[50], rows[51], (1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1050, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, block string, kind int")
    got = sorted(tuple(r) for r in top_k(df, 5, 50, 256, block).collect())
    assert got == brute_top(rows, 5)
    assert top_k(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 3)) * 2.0**21).astype(np.float32)
    x[1] = x[2] = [2.0**22, 1.0, 0.0]
    x[3] = [2.0**22, 1.0, 1 / 256]
    x[50] = [2.0**22, 3.0, 1.0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert max(abs(s) for *_, s in brute_top(rows, 5)) > 2**53
    for block in (8, 1000):
        assert sorted(tuple(r) for r in top_k(df, 5, 50, 256, block).collect()) == brute_top(rows, 5)
    huge = spark.createDataFrame([(50, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [1e308])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(huge).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_trees_prune_clustered_vectors():
    """Most pairs of clustered vectors are never scored; those of evenly spread ones nearly all are."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 32))
    for spread, most in ((0.05, 0.12), (None, 1.0)):
        x = centers[rng.integers(0, 60, 3000)] + spread * rng.normal(size=(3000, 32)) if spread else rng.normal(size=(3000, 32))
        x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
        ids, q = np.arange(3000), np.arange(0, 3000, 50)
        s = Search(x, ids, x[q], q, 5)
        s.run(tree(x))
        got = x[q] @ x.T
        got[np.arange(len(q)), q] = -np.inf
        assert (np.sort(got, axis=1)[:, :-6:-1] == s.score).all()
        assert s.scored <= most * 3000 * len(q), s.scored / 3000 / len(q)


def test_queries_skip_balls_out_of_reach():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 16)) * 100
    x = np.floor(centers[rng.integers(0, 20, 1000)] + rng.normal(size=(1000, 16)))
    top = Top({16: np.floor(centers)}, {16: 0})
    ball, far = top.nearest(x)
    for b in np.unique(ball):
        top.radius[int(b)], top.parts[int(b)] = float(far[ball == b].max()), (int(b), 1)
    floor = np.sort(x[:40] @ x.T, axis=1)[:, -6]
    met = [set(a) | set(b) for a, b in zip(routes(top, x[:40], floor, True), routes(top, x[:40], floor, False), strict=True)]
    assert sum(map(len, met)) < 40 * 20 / 3
    for i, balls in enumerate(met):
        assert set(ball[np.flatnonzero(x[i] @ x.T >= floor[i])]) <= balls
