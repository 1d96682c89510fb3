"""Personal data by patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns.  A semi-Markov CRF then scores whole candidate spans: features
look at all of a span (shape, digits, checksum, the words before it), entities are at most MOST_TOKENS
tokens and MOST_CHARS code points long and hold an anchor (a digit, an at-sign, also spelled (at) or
[at]), and dynamic programming chooses boundaries and types together.  As tokens farther than
MOST_TOKENS from every anchor can be in no candidate and score 0, only the stretches between are
decoded, with the same result as for the whole text.  The weights are learned here, by likelihood, from
sentences made by a rule from a seed (SENTENCES of them).  Spans that it finds apart from base spans
are added.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field may add, in the order in which equal starts are listed.
ALL_KINDS = (*KINDS, "secret", "ssn")
MOST_TOKENS = 14
MOST_CHARS = 128
LEAST_CHARS = 6
SENTENCES = 900
EPOCHS = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at-signs so that long runs cost no more than one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = end = m.end()
        else:
            done = at + 1  # the next local part begins after this at-sign
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) in order of start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_only_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ALL_KINDS.index(s[2]), s[1]))


# ---- the field

_TOKEN = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]|[A-Za-z0-9_]{16,}|[A-Za-z]+|[0-9]+|[^\W\d_]+|\s+|[^\sA-Za-z0-9]", re.I)
_ANCHOR = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)
_SHAPES = (
    ("dashed", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("plus", re.compile(r"\+[0-9][0-9 ().-]{8,18}[0-9]")),
    ("mail", re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)+", re.I)),
    ("quad", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("groups", re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){3}")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("hex", re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})")),
    ("code", re.compile(r"(?=[A-Za-z_]*[0-9])(?=[0-9_]*[A-Za-z])[A-Za-z0-9_]{16,64}")),
    ("snake", re.compile(r"(?:[A-Za-z]+|[A-Za-z]?[0-9]+)(?:_(?:[A-Za-z]+|[A-Za-z]?[0-9]+))+")),
    ("pass", re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9!#$%&*^_-]{6,40}")),
    ("number", re.compile(r"[0-9]+")),
    ("word", re.compile(r"[A-Za-z]+")),
)
_CUES = (
    ("cue-phone", re.compile(r"(?:phone|tel|call|mobile|fax)[^A-Za-z0-9]{0,3}$", re.I)),
    ("cue-secret", re.compile(r"(?:token|secret|key|passw(?:or)?d|pwd|auth)(?: is)?[^A-Za-z0-9]{1,5}$", re.I)),
    ("cue-card", re.compile(r"(?:card|visa|pay)[^A-Za-z0-9]{0,3}$", re.I)),
    ("cue-ssn", re.compile(r"(?:ssn|social security(?: number)?)[^A-Za-z0-9]{0,3}$", re.I)),
)


def features(text: str, start: int, stop: int, tokens: int) -> list[str]:
    """Features of a whole candidate span, joined with each type by the field."""
    span = text[start:stop]
    out = [f"shape-{name}" for name, shape in _SHAPES if shape.fullmatch(span)] or ["shape-none"]
    before = text[max(0, start - 32) : start]
    cues = [name for name, cue in _CUES if cue.search(before)]
    digits = _only_digits(span)
    if 14 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if "shape-quad" in out:
        try:
            ipaddress.ip_address(span)
            out.append("octets")
        except ValueError:
            out.append("no-octets")
    out += cues + [f"{c}&{s}" for c in cues for s in out if s.startswith("shape")]
    out.append(f"digits-{min(len(digits), 20) // 4}")
    out.append(f"tokens-{min(tokens, 8)}")
    edge = (start > 0 and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum())
    return out + ["cut" if edge else "free"]


class Region:
    """A stretch of text as a lattice: every token may stand alone as no entity, or begin a candidate."""

    def __init__(self, text: str, start: int, stop: int):
        self.tokens = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:stop])]
        blank = [text[a].isspace() for a, _ in self.tokens]
        hot = [bool(_ANCHOR.search(text, a, b)) for a, b in self.tokens]
        self.candidates: list[list[tuple[int, list[str]]]] = []  # by first token: (token after the last, features)
        for i in range(len(self.tokens)):
            own = []
            if not blank[i]:
                seen = False
                for j in range(i, min(len(self.tokens), i + MOST_TOKENS)):
                    seen = seen or hot[j]
                    size = self.tokens[j][1] - self.tokens[i][0]
                    if size > MOST_CHARS:
                        break
                    if seen and not blank[j] and size >= LEAST_CHARS:
                        own.append((j + 1, features(text, self.tokens[i][0], self.tokens[j][1], j + 1 - i)))
            self.candidates.append(own)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of tokens with an anchor within MOST_TOKENS; all candidates lie within them."""
    if not _ANCHOR.search(text):
        return
    start = stop = -1
    left: list[int] = []  # starts of the last tokens
    after = 0
    for m in _TOKEN.finditer(text):
        left.append(m.start())
        if len(left) > MOST_TOKENS:
            del left[0]
        if _ANCHOR.search(text, m.start(), m.end()):
            if start >= 0 and left[0] > stop:
                yield start, stop
                start = -1
            if start < 0:
                start = left[0]
            after = MOST_TOKENS
        if after:
            stop, after = m.end(), after - 1
    if start >= 0:
        yield start, stop


class Field:
    """Weights by (kind, feature); a token outside entities scores 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, kind: str, found: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in found) + get((kind, "bias"), 0.0)

    def best(self, region: Region) -> list[tuple[int, int, str]]:
        """The best segmentation's entities as (start, stop, kind)."""
        n = len(region.tokens)
        value, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
        for i in range(n):
            if value[i] > value[i + 1]:
                value[i + 1], back[i + 1] = value[i], (i, "")
            for j, found in region.candidates[i]:
                for kind in ALL_KINDS:
                    if (s := value[i] + self.score(kind, found)) > value[j]:
                        value[j], back[j] = s, (i, kind)
        out, at = [], n
        while at:
            i, kind = back[at]
            if kind:
                out.append((region.tokens[i][0], region.tokens[at - 1][1], kind))
            at = i
        return out[::-1]

    def learn(self, samples: list[tuple[Region, set[tuple[int, int, str]]]], epochs: int, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Gradient ascent on the log likelihood, sample by sample: observed less expected features."""
        w = self.weights
        for epoch in range(epochs):
            step = rate / (1 + 0.3 * epoch)
            for region, truth in samples:
                n = len(region.tokens)
                arcs = [[(j, kind, found, self.score(kind, found)) for j, found in own for kind in ALL_KINDS] for own in region.candidates]
                ahead = [0.0] + [-math.inf] * n
                for i in range(n):
                    ahead[i + 1] = _plus(ahead[i + 1], ahead[i])
                    for j, _, _, s in arcs[i]:
                        ahead[j] = _plus(ahead[j], ahead[i] + s)
                behind = [-math.inf] * n + [0.0]
                for i in range(n - 1, -1, -1):
                    behind[i] = _plus(behind[i], behind[i + 1])
                    for j, _, _, s in arcs[i]:
                        behind[i] = _plus(behind[i], behind[j] + s)
                for i in range(n):
                    for j, kind, found, s in arcs[i]:
                        seen = (region.tokens[i][0], region.tokens[j - 1][1], kind) in truth
                        gap = seen - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
                        if abs(gap) > 1e-4:
                            for f in (*found, "bias"):
                                old = w.get((kind, f), 0.0)
                                w[kind, f] = old + step * (gap - decay * old)


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def sentences(count: int = SENTENCES, seed: int = 17) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """Made-up sentences with their entities: real shapes, and near misses that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def number(valid: bool) -> str:
        body = digits(15)
        return body + next(c for c in "0123456789" if luhn(body + c) == valid)

    def entity() -> tuple[str, str, str]:
        pick = r.randrange(13)
        if pick == 0:
            return "", f"{word()}{r.choice(['.', '_', ''])}{digits(r.randint(0, 2))}{word()}@{word()}.{r.choice(['example.com', 'net', 'org'])}", "email"
        if pick == 1:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("[at]", ".")])
            body = f"{word()}{r.choice(['.', '_', ''])}{word()}{digits(r.choice([0, 2]))} {at} {word()} {dot} {r.choice(['com', 'net', 'org'])}".replace(" . ", ".")
            return "", r.choice([body, body.replace(" ", "")]), "email"
        if pick == 2:
            return "", ".".join(str(r.randint(1, 255)) for _ in range(4)), "ip"
        if pick == 3:
            n, s = number(True), r.choice(["", " ", "-", "."])
            return r.choice(["", "card ", "pay "]), s.join(n[i : i + 4] for i in range(0, 16, 4)), "card"
        if pick == 4:
            return r.choice(["", "tel "]), f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", "phone"
        if pick in (5, 6):
            return r.choice(["phone ", "call ", "tel: ", ""]), r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), "phone"
        cue = r.choice(["token = \"", "key: ", "secret=", "password: ", "passwd=", "auth token is "])
        if pick in (7, 8):
            return cue, "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "secret"
        if pick == 9:
            code = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.choice([16, 20, 36])))
            return r.choice([cue, ""]), r.choice(["", "ab_", "AK"]) + digits(1) + code + "x7", "secret"
        if pick == 10:
            return r.choice(["password: ", "passwd=", "pwd "]), f"{word()}ax{r.choice(['', '_', '!', '-'])}{digits(r.randint(1, 4))}{word()[:2]}", "secret"
        if pick == 11:
            return r.choice(["ssn ", "social security number ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}", "ssn"
        miss = r.randrange(10)
        if miss == 9:
            return "", "_".join([word(), word(), r.choice([word(), digits(2)]), word(), digits(r.randint(1, 2))]), ""
        if miss == 6:
            return "", f"{word()}ax{r.choice(['', '_', '-'])}{digits(r.randint(1, 4))}", ""
        if miss == 7:
            return r.choice(["token ", "key "]), word() + word(), ""
        if miss == 8:
            return "", f"{digits(4)}-{digits(2)}-{digits(3)}", ""
        if miss == 5:
            return "", r.choice([f"{word()} (at) {word()}", f"{word()}[at] {word()}"]), ""
        if miss == 0:
            return "", number(False), ""
        if miss == 1:
            return "", ".".join(str(r.randint(300, 999)) for _ in range(4)), ""
        return "", digits(r.randint(7, 13)) if miss == 2 else f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}" if miss == 3 else f"{digits(2)}.{digits(5)}", ""

    for _ in range(count):
        text, truth = " ".join(word() for _ in range(r.randint(0, 5))), set()
        loud = r.random() < 0.15
        for _ in range(r.randint(1, 2)):
            cue, body, kind = entity()
            text = f"{text} {cue}" if text else cue
            if kind:
                truth.add((len(text), len(text) + len(body), kind))
            text += body + r.choice(["", ".", ",", "\"", "!!" if loud else ""]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        yield (text.upper() if loud else text), truth


@lru_cache(maxsize=1)
def trained_field(count: int = SENTENCES, epochs: int = EPOCHS) -> Field:
    """The field learned from ``count`` made-up sentences: the same in every run."""
    out = Field()
    out.learn([(Region(t, a, b), truth) for t, truth in sentences(count) for a, b in regions(t)], epochs)
    return out


def all_spans(text: str, field: Field, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    """Base spans and those that the field adds, by start, then kind."""
    base = base_spans(text) if base is None else base
    out, at, end = list(base), 0, 0
    for a, b in regions(text):
        for start, stop, kind in field.best(Region(text, a, b)):  # ascending, as base spans are
            while at < len(base) and base[at][0] < stop:
                end, at = max(end, base[at][1]), at + 1
            if end <= start:
                out.append((start, stop, kind))
    return sorted(out, key=lambda s: (s[0], ALL_KINDS.index(s[2]), s[1]))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_spans: a row per row of ``docs``.

    docs: doc_id and text; other columns are ignored.  The counts and ``base`` are of base spans,
    ``spans`` has those and the added ones, each as kind:start:stop in code points, stop exclusive,
    by start, then kind, joined by commas, ``n_spans`` counts them.  Null text is empty (no spans, empty
    strings); long texts are taken whole; of equal segmentations the shorter last entity wins; repeated
    rows give repeated results; an empty table gives no rows.
    """
    field = field or trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                spans = all_spans(text, field, base)
                rows.append((*counts, _listed(base), _listed(spans), len(spans)))
            if rows:
                columns = [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")


def masked(text: str, field: Field) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for start, stop, kind in all_spans(text, field):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = stop
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
