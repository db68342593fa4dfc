"""Brute-force versions for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def byte_repeats(docs, length=100):
    """{row: (n_bytes, n_removed, n_spans, sha256)}; docs: [(doc_id, text)], ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def shingle_set(text, k):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_components(docs, k=3, percent=90):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for n, (i, _) in enumerate(sets):
        r = root(n)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [(i, len(s), least[root(n)] if s else i) for n, (i, s) in enumerate(sets)]


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1):
            if k:
                wins[tuple(w[p : p + k])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = alnum(t)
        hit, found = set(), set()
        for p in range(len(w)):
            for k in sizes:
                g = tuple(w[p : p + k])
                if len(g) == k and g in wins:
                    hit.update(range(p, p + k))
                    found |= wins[g]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def in_training(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus != 0
