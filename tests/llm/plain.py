"""Plain versions of the operators' definitions, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


def shingles(t, n):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_groups(texts, n, percent):
    """Root index of each text; None for texts without words."""
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) if s else None for k, s in enumerate(sets)], [len(s) for s in sets]


def repeated(texts, length):
    """Byte masks of what a repeated string of ``length`` bytes covers."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        out.append((b, bytes(mask)))
    return out


def base_counts(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(grams)
    inside = {k + i for k, g in enumerate(grams) if n[g] > 1 for i in range(8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)
