"""The contracts once more, row by row in plain Python, to hold results against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Groups:
    """Union by smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def of(self, m):
        while self.up[m] != m:
            self.up[m] = self.up[self.up[m]]
            m = self.up[m]
        return m

    def join(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self.up[b] = a


def near_vectors(rows, threshold=0.93):
    """rows: (vec_id, vector, label).  (vec_id, n_links, component_id, kept) of each row,
    and the number of links."""
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kinds = {}
    for k, (_, v, lab) in enumerate(rows):
        if lab is not None and ok(v):
            kinds.setdefault((lab, len(v)), []).append(k)
    groups, n, links = Groups(range(len(rows))), [0] * len(rows), 0
    for own in kinds.values():
        m = np.array([rows[k][1] for k in own], "f8")
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            a, b = own[a], own[b]
            groups.join(a, b)
            n[a] += 1
            n[b] += 1
            links += 1
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[groups.of(k)] = min(least.get(groups.of(k), i), i)
    comp = [least.get(groups.of(k), i) for k, (i, *_) in enumerate(rows)]
    return [(i, n[k], comp[k], i == comp[k]) for k, (i, *_) in enumerate(rows)], links


def topk(rows, k=20, every=20):
    """rows: (vec_id, vector).  Set of (query_id, rank, vec_id, score); vectors meet those of
    their length."""
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(a) == len(b))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


def passages(rows, window=13):
    """rows: (doc_id, text).  [(doc_id, n_words, n_removed, kept_sha256)] in order."""
    words = [SPACE.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone).encode())))
    return out


def license_base(text, phrases):
    words = TERM.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_added(text, templates):
    """Labels and the best containment over runs of words (templates as prepared)."""
    words, labels, best = TERM.findall((text or "").translate(LOWER)), set(), 0.0
    for t in templates:
        for k, w in enumerate(words):
            if w in t.tokens:
                have = set(words[k : k + t.run]) & set(t.tokens)
                if len(have) >= t.need and have >= set(t.required):
                    labels.add(t.label)
                    best = max(best, len(have) / len(t.tokens))
    return labels, best


def simhash(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_prints(rows, radius=4):
    """rows: (doc_id, text).  (doc_id, fingerprint, component_id) of each.  Nodes are ids
    and fingerprints; a null id adds no node."""
    prints = [(i, simhash(t)) for i, t in rows]
    own = sorted({p for _, p in prints})
    groups = Groups([*((0, i) for i, _ in prints if i is not None), *((1, p) for p in own)])
    for i, p in prints:
        if i is not None:
            groups.join((0, i), (1, p))
    for k, p in enumerate(own):
        for q in own[k + 1 :]:
            if (p ^ q).bit_count() <= radius:
                groups.join((1, p), (1, q))
    root = {p: groups.of((1, p)) for p in own}
    return [(i, format(p, "016x"), root[p][1] if root[p][0] == 0 else None) for i, p in prints]


def shingled(text, k=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(rows, similarity=0.8):
    """rows: (doc_id, text).  The ids of the first document of each group that shingle sets
    of this Jaccard join."""
    sets = [shingled(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or [None]:
            holders[x].append(k)
    groups = Groups(range(len(rows)))
    for k, s in enumerate(sets):
        for m in {m for x in s or [None] for m in holders[x] if m < k}:
            if len(s & sets[m]) >= similarity * len(s | sets[m]):
                groups.join(k, m)
    return sorted({rows[groups.of(k)][0] for k in range(len(rows))})


def best_fit(pieces, capacity):
    """pieces: (size, source, cluster) in order.  A linear search for the tightest
    compatible bin (ties: the bin opened first): (bin, offset) of each."""
    seen = defaultdict(int)
    for *_, c in pieces:
        seen[c] += 1
    bins, out = [], []
    for n, s, c in pieces:
        c = c if seen[c] > 1 else None
        fits = [(capacity - used, b) for b, (used, ss, cc) in enumerate(bins) if n <= capacity - used and (s is None or s not in ss) and (c is None or c not in cc)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([0, set(), set()])
        out.append((b, bins[b][0]))
        bins[b][0] += n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
