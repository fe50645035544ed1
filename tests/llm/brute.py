"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


def substring_dedup(rows, window):
    """rows: (doc_id, text); -> {(doc_id, text): (n_words, n_removed, sha256)}"""
    order = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            at = ((doc is not None, doc or 0), i)
            order[tuple(w[i:i + window])] = min(at, order.get(tuple(w[i:i + window]), at))
    out = {}
    for doc, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if order[tuple(w[i:i + window])] < ((doc is not None, doc or 0), i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc, text] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text, shingle=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    runs = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    """fps: list of ints -> list of component labels (smallest position)"""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best
