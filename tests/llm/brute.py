"""Plain versions of the operators, for small inputs only."""

import collections
import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONBLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hits(texts, items, size=10):
    """Per text (words, hit words, items, digest of the items)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(str(item))
    out = []
    for text in texts:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i:i + k]))):
                    found |= got
                    hit |= set(range(i, i + k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def shingles(text):
    w = NONBLANK.findall(low(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(ids, linked):
    """Smallest id reachable over ``linked(a, b)``."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    return joined(list(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
