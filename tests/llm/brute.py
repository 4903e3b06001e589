"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict


def components(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard_components(rows, n=4, percent=85):
    sets = {i: shingles(t, n) for i, t in rows}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    links, compared = set(), set()
    for members in by.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in compared:
                    compared.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links.add((a, b))
    return {i: len(s) for i, s in sets.items()}, components(sets, links)


def kept_bytes(rows, length=50):
    """id -> (bytes, removed, runs, what is left), rows sorted by id."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        grams = [data[k : k + length] for k in range(len(data) - length + 1)]
        gone = [False] * len(data)
        for k, g in enumerate(grams):
            if first.get(g, i) < i:
                gone[k : k + length] = [True] * length
        for g in grams:
            first[g] = min(first.get(g, i), i)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = []
    for phrase, label in BASE.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), found


KINDS = [
    ("assign", re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def secret_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return [f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]
