"""Word dedup by suffix trees over prefix groups.

``repeats`` brings the contexts of one bucket together. Their suffixes, each a window
of words, are split by variable-length prefixes: by the first word, and where a group
is larger than ``GROUP`` suffixes by one word more, down to the whole window. Small
groups share a batch; each batch's subtree is built on its own: its sorted suffixes
with the depths at which neighbours part. The internal nodes at window depth are the
repeats; below such a node all suffixes but the earliest are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from wardlight.llm.common import ranges, runs_of, text_buffer, word_spans
from wardlight.llm.repeats import Contexts, Shape, Stretches, with_removals

WINDOW, GRAM = 20, 4
GROUP = 200_000
SHAPE = Shape(WINDOW, GRAM, np.uint32)


def prefix_groups(symbols: np.ndarray, at: np.ndarray, depth: int, most: int = GROUP) -> Iterator[np.ndarray]:
    """Suffix starts in batches of whole prefix groups. A group above ``most``
    suffixes is split by its next word; at full depth all its suffixes are equal and
    it stays together."""
    todo = [(at, 0)]
    batch: list[np.ndarray] = []
    held = 0
    while todo:
        group, length = todo.pop()
        if len(group) > most and length < depth:
            word = symbols[group + length]
            order = np.argsort(word, kind="stable")
            first, count = runs_of(word[order])
            small = np.repeat(count <= most, count)
            todo += [(group[order[f : f + n]], length + 1) for f, n in zip(first, count) if n > most]
            group = group[order[small]]  # whole prefix groups, cut into batches below
            edges = np.cumsum(count[count <= most])
            cuts = np.unique(np.searchsorted(edges, np.arange(most, len(group) + most, most), "left"))
            pieces = np.split(group, edges[cuts[cuts < len(edges)]]) if len(edges) else []
        else:
            pieces = [group]
        for piece in pieces:
            if held + len(piece) > most and batch:
                yield np.concatenate(batch)
                batch, held = [], 0
            if len(piece):
                batch.append(piece)
                held += len(piece)
    if batch:
        yield np.concatenate(batch)


def subtree(symbols: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a batch's subtrees in order, and the depth of the node at which each
    parts from the leaf before (0 for the first)."""
    words = np.ndarray((len(symbols) - 1,), np.uint64, np.ascontiguousarray(symbols).data, strides=(4,))
    keys = [words[at + k] for k in range(0, depth, 2)]
    order = np.lexsort(keys[::-1])
    at = at[order]
    parted = np.full(len(at), depth, np.int32)
    parted[:1] = 0
    left = np.arange(1, len(at))
    for k in range(depth):
        same = symbols[at[left] + k] == symbols[at[left - 1] + k]
        parted[left[~same]] = k
        left = left[same]
    return at, parted


def deep_nodes(parted: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node at ``depth`` above each leaf; leaves alone have their own."""
    return np.cumsum(parted < depth) - 1


def find_later(held: Contexts) -> Stretches:
    """Every window that also starts earlier, in these contexts."""
    at = held.starts(WINDOW)
    starts = ranges(at[:-1], held.n.astype(np.int64))
    owner = np.zeros(len(held.symbols), np.int32)
    owner[starts] = np.repeat(np.arange(len(held.n)), held.n)
    hit = np.zeros(len(held.symbols), bool)
    for batch in prefix_groups(held.symbols, starts, WINDOW):
        leaves, parted = subtree(held.symbols, batch, WINDOW)
        node = deep_nodes(parted, WINDOW)
        c = owner[leaves]
        doc, place = held.doc[c], held.lo[c] + leaves - at[c]
        order = np.lexsort((place, doc, node))
        first = np.concatenate(([True], node[order][1:] != node[order][:-1]))
        hit[leaves[order[~first]]] = True
    found = np.flatnonzero(hit)
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    c = owner[found]
    new = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (c[1:] != c[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    lo = held.lo[c[first]] + found[first] - at[c[first]]
    return held.doc[c[first]], lo, lo + (found[last] - found[first]) + WINDOW


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs``: words covered by
    a run of 20 words that also starts earlier are taken out; the others are joined by
    one space. A null text has no words; a row without an id keeps all of them;
    identical rows are one document, rows of one id with different texts are documents of
    their own, of which the one with the smaller text hash comes first."""
    import pyarrow as pa

    def apply(text, starts, ends):
        data, off = text_buffer(pa.array([text], pa.string()))
        a, b, _ = word_spans(data, off)
        keep = np.ones(len(a), bool)
        keep[ranges(starts, np.minimum(ends, len(a)) - starts)] = False
        raw = text.encode()
        kept = b" ".join([raw[s:e] for s, e in zip(a[keep].tolist(), b[keep].tolist())])
        return len(a), int((~keep).sum()), kept.decode()

    return with_removals(docs, SHAPE, find_later, True, apply, "n_words long, n_removed long, kept string")
