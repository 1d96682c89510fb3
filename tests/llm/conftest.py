import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, node string, text_key string, score string, key string, held_out string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with more columns whose names operators use themselves."""

    def build(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", "x", "x", "x", "x", "x") for r in rows], DDL)

    return build


WORDS = [f"{a}{b}{c}" for a in "blmrst" for b in "aeiou" for c in ("n", "ra", "lo", "tis", "que")]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near and exact copies."""
    import random

    r = random.Random(4)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, say(r.randint(20, 120)), r.choice(["en", "fr"]), f"s{i % 3}") for i in range(1, 40)]
    for i in range(40, 70):
        base = rows[r.randrange(39)][1].split()
        for _ in range(r.randint(0, 4)):
            base[r.randrange(len(base))] = r.choice(WORDS)
        rows.append((i, " ".join(base), "en", "s1"))
    rows += [(70, None, None, None), (71, "", "en", "s0"), (72, " \n\t ", "en", None), (73, "solo", None, "s1"), (74, "two words", "fr", "s2"), (75, "two  WORDS", "fr", "s2")]
    rows += [(76, say(60_000), "en", "s0"), (77, "12 34 -- !!", "en", "s0"), (None, say(30), "en", "s1"), (None, None, None, None)]
    rows += [rows[0], rows[0], rows[45], (78, rows[3][1], "en", "s2"), (1, rows[7][1], "en", "s0")]
    return rows
