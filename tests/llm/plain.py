"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
                          ("mit license", "mit")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def jaccard_classes(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def cut_repeats(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone, end = [], 0
        for i in range(len(r)):
            if i + window <= len(r) and seen[r[i:i + window]] > 1:
                end = i + window
            gone.append(i < end)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def waterfill(sizes, weights, cap):
    """Targets of sources in order: shares by weight, the excess over the cap reshared until none is above."""
    total, done = float(sum(sizes)), {}
    while True:
        rest = total - sum(done.values())
        weight = sum(w for i, w in enumerate(weights) if i not in done)
        share = {i: rest * w / weight for i, w in enumerate(weights) if i not in done} if weight else {}
        over = [i for i, s in share.items() if s > cap * sizes[i] + 1e-9]
        if not over:
            return [done.get(i, share.get(i)) for i in range(len(sizes))]
        done |= {i: cap * sizes[i] for i in over}


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
