"""Plain versions of the operators, for small inputs."""

import collections
import re
import zlib


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def groups(rows, k, p, q):
    """[(doc_id, text)] -> [(doc_id, set size, smallest id)]"""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                up[top(i)] = top(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[top(i)].append(d)
    least = {g: min((d for d in own if d is not None), default=None) for g, own in ids.items()}
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d *= 2
            if d > 9:
                d -= 9
        total += d
    return total % 10 == 0


ORDER = ("email", "ip", "card", "phone", "secret")


def spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (14 <= len(d) <= 19 and luhn(d)) if kind == "card" else 10 <= len(d) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


def targets(sizes, cap=3):
    """{source: size} -> {source: target} by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
