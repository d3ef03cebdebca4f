"""Brute-force versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return WORD.findall(t)


def shingle_set(text, k=5):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard_components(rows, percent=75):
    """rows of (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].add(i)
    for i, (d, s) in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j > i)
        for j, c in common.items():
            e, t = sets[j]
            if 100 * c >= percent * (len(s) + len(t) - c):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets)


def substring_dedup(rows, window=13):
    import hashlib
    first = {}
    texts = [(d, words(t)) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in texts:
        cut = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                cut.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out.append((d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def leaks(docs, items, percent=75):
    """(doc_id, item_id) where at least percent of the item's distinct shingles occur in the document."""
    sets = [(i, shingle_set(t)) for i, t in items]
    out = []
    for d, t in docs:
        s = shingle_set(t)
        out += [(d, i) for i, g in sets if g and 100 * len(s & g) >= percent * len(g)]
    return sorted(out)
