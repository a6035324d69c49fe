"""Plain versions of the operators, for small tables. Documents are (id, text) pairs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def keyed(docs):
    """One text per id, the rows without an id left out."""
    return {k: t or "" for k, t in docs if k is not None}


def texts_in_order(docs):
    """The different texts of each id, by id and then by the hash of the text."""
    place = lambda d: (d[0], xxhash.xxh64(d[1].encode(), 42).intdigest() >> 33)
    return sorted({(k, t or "") for k, t in docs if k is not None}, key=place)


def link_classes(docs):
    sets = {}
    for k, t in keyed(docs).items():
        w = WORD.findall(t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def language(docs):
    words = [(k, WORD.findall((t or "").translate(LOWER)) + [None]) for k, t in docs]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter()
    for k, w in words:
        if not held(k):
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [
        (k, held(k), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        for k, w in words
    ]


def word_dedup(docs):
    seen, out = set(), {}
    for k, t in texts_in_order(docs):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            if run in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(run)
        out[k, t] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def byte_dedup(docs, window=200):
    texts = {d: d[1].encode() for d in texts_in_order(docs)}
    c = Counter(b[i : i + window] for b in texts.values() for i in range(len(b) - window + 1))
    out = {}
    for k, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if c[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out[k] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)
    return out


def line_dedup(docs, min_docs=5, min_length=40):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = defaultdict(set)
    for k, t in docs:
        for line in (t or "").split("\n"):
            if k is not None and len(key(line)) >= min_length:
                where[key(line)].add(k)
    out = []
    for k, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fewest_edits(pattern: bytes, text: bytes) -> int:
    """Edits of the best match of a pattern anywhere in a text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best
