"""Plain statements of what the operators must return, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """doc_id -> smallest linked doc_id, from (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, (_, s) in enumerate(sets):
        share = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > i:
                    share[j] += 1
        for j, n in share.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


def contamination(text, items):
    w, hit, met = alnum(text), set(), set()
    for item, t in items:
        v = alnum(t)
        if not v:
            continue
        n = min(10, len(v))
        for k in range(len(v) - n + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    met.add(str(item))
    return len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)


def crc(x):
    return zlib.crc32(x)
