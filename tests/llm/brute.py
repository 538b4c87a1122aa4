"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(A_TO_Z)


def shingles(text):
    w = WORD(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def components(docs):
    """doc_id -> (set size, component), over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(docs, min_chars=40, min_docs=5):
    """doc_id -> (lines, dropped, kept text)."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in docs}
    for i, ls in split.items():
        for x in ls:
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = {}
    for i, ls in split.items():
        kept = [x for x in ls if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def targets(sizes, weights=(5, 2, 1), repeat=3):
    """source -> target, by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(repeat * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        now = {s: repeat * sizes[s] if s in capped else left * w[s] / share for s in names}
        over = {s for s in names if s not in capped and now[s] >= repeat * sizes[s]}
        if not over:
            return now
        capped |= over


def repeat_words(text):
    w = WORD(text or "")
    g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = collections.Counter(g)
    return len({k + j for k, x in enumerate(g) if n[x] > 1 for j in range(5)})


def leaks(docs, items, least=0.8):
    """(doc_id, item_id) with a window of the item's length that is similar enough."""
    found = set()
    for i, text in docs:
        w = TERM(lower(text))
        for j, item in items:
            b = TERM(lower(item))
            if not b:
                continue
            k = min(5, len(b))
            want = collections.Counter(tuple(b[x : x + k]) for x in range(len(b) - k + 1))
            have = [tuple(w[x : x + k]) for x in range(len(w) - k + 1)]
            for at in range(len(have)):
                part = collections.Counter(have[at : at + len(b) - k + 1])
                if sum((part & want).values()) >= least * sum((part | want).values()):
                    found.add((i, j))
                    break
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
