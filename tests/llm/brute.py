"""Plain versions of the operators, one row after another."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def crc_of_ids(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def shingle_set(text, size):
    w = NONSPACE.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def jaccard_components(docs, size, p, q):
    """{doc_id: (n_shingles, component_id)} of [(doc_id, text)]."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        by[s].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for s, ds in by.items():
        for d in ds[1:] if s else []:
            join(ds[0], d)
    index = defaultdict(list)
    order = sorted((s for s in by if s), key=len)
    for s in order:
        seen = defaultdict(int)
        for x in s:
            for t in index[x]:
                seen[t] += 1
        for t, n in seen.items():
            if q * n >= p * (len(s) + len(t) - n):
                join(by[s][0], by[t][0])
        for x in s:
            index[x].append(s)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def leaks(text, items, window=10):
    """(n_words, n_hit, sorted item ids) of a text, for [(item_id, text)]."""
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = ALNUM.findall(lower(t))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            part = w[i : i + n]
            for k in range(len(words) - n + 1):
                if words[k : k + n] == part:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
