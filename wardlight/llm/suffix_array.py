"""Byte dedup by suffix sorting, block by block, with a difference cover.

``repeats`` brings the contexts of one bucket together. Their suffixes are sorted
one block at a time: by the first ``PERIOD`` bytes, and where those tie, by ranks of
a difference-cover sample computed beforehand. For any two places there is a shift
below ``PERIOD`` that takes both to sampled places, so every tie is one comparison
of ranks however long the common text is. Memory is the bucket's text, its sample
and one block. Neighbours with ``window`` bytes in common are the repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from wardlight.llm.common import ranges, runs_of
from wardlight.llm.repeats import Contexts, Shape, Stretches, with_removals

WINDOW, GRAM = 200, 32
PERIOD = 31
# fixed values: a perfect difference set modulo 31
COVER = (0, 1, 3, 8, 12, 18)
BLOCK = 1 << 19
SHAPE = Shape(WINDOW, GRAM, np.uint8)


def shifts() -> np.ndarray:
    """Shift for each pair of residues that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if inside[a + d] and inside[b + d])
    return table


SHIFTS = shifts()


class SampledText:
    """Bytes with the ranks of their cover sample, by ``depth`` bytes at least."""

    def __init__(self, text: np.ndarray, depth: int):
        steps = 0
        while PERIOD << steps < depth + PERIOD:
            steps += 1
        self.size = len(text)
        self.text = np.concatenate((text, np.zeros((PERIOD << steps) + 2 * PERIOD + 8, np.uint8)))
        self.eights = np.ndarray((len(self.text) - 7,), ">u8", self.text.data, strides=(1,))
        places = np.flatnonzero(np.isin(np.arange(PERIOD), COVER))
        base = np.arange(0, self.size + 2 * PERIOD, PERIOD)
        sample = (base[:, None] + places[None, :]).ravel()
        # row r of a cover residue is PERIOD after row r - 1, so a doubling step is a shift of rows
        rank = self._ranked([self.chunk(sample, k) for k in range(4)])
        for step in range(steps):
            ahead = np.zeros(len(rank), np.int64)
            move = len(places) << step
            ahead[: max(0, len(rank) - move)] = rank[move:] + 1
            rank = self._ranked([(rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)])
        self.rank = rank
        self.column = np.full(PERIOD, -1, np.int64)
        self.column[places] = np.arange(len(places))
        self.width = len(places)

    def chunk(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 after each place as numbers, the fourth without its last."""
        value = self.eights[at + 8 * k].astype(np.uint64)
        return value >> np.uint64(8) if k == 3 else value

    @staticmethod
    def _ranked(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), bool)
        for key in keys:
            sorted_ = key[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * self.width + self.column[at % PERIOD]]

    def sorted_block(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in suffix order and, for each, whether the sample proved it equal
        to the one before."""
        keys = [self.chunk(at, k) for k in range(4)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            sorted_ = key[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        at = at[order]
        group = np.cumsum(new) - 1
        equal = np.zeros(len(at), bool)
        # ties: quicksort of all groups side by side, each round around one pivot a group
        open_ = np.arange(len(at))
        while True:
            first, length = runs_of(group[open_])
            tied = np.repeat(length > 1, length)
            if not tied.any():
                break
            open_ = open_[tied]
            first, length = runs_of(group[open_])
            here = at[open_]
            pivot = np.repeat(here[first + length // 2], length)
            shift = SHIFTS[here % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank_at(here + shift) - self.rank_at(pivot + shift)) + 1
            key = np.repeat(np.arange(len(first)), length) * 3 + side
            turn = np.argsort(key, kind="stable")
            at[open_] = here[turn]
            key = key[turn]
            same = key % 3 == 1
            run_first, run_length = runs_of(key)
            begins = np.zeros(len(key), bool)
            begins[run_first] = True
            equal[open_[same & ~begins]] = True
            # new group numbers only need to differ within the open places
            group[open_] = np.repeat(np.arange(len(run_first)), run_length)
            done = np.repeat((run_length == 1) | (key[run_first] % 3 == 1), run_length)
            open_ = open_[~done]
            if not len(open_):
                break
        return at, equal

    def common(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether ``length`` bytes after a and b agree."""
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        for k in [*range(0, length - 8, 8), length - 8]:
            same = self.eights[a[left] + k] == self.eights[b[left] + k]
            out[left[~same]] = False
            left = left[same]
        return out


def equal_windows(text: np.ndarray, at: np.ndarray, window: int, block: int = BLOCK):
    """Window starts in suffix order, block by block, with the number of the class of
    equal windows each belongs to."""
    held = SampledText(text, window)
    lead = held.eights[at].astype(np.uint64)
    blocks = max(1, -(-len(at) // block))
    edges = np.unique(np.sort(lead[:: max(1, len(lead) // (64 * blocks))])[:: 64]) if blocks > 1 else np.zeros(0, np.uint64)
    home = np.searchsorted(edges, lead, "right")
    order = np.argsort(home, kind="stable")
    first, length = runs_of(home[order])
    for f, n in zip(first, length):
        places, equal = held.sorted_block(at[order[f : f + n]])
        joined_ = equal.copy()
        ask = np.flatnonzero(~equal[1:]) + 1
        joined_[ask] = held.common(places[ask - 1], places[ask], window)
        yield places, np.cumsum(~joined_) - 1


def find_equal(held: Contexts) -> Stretches:
    """Every window that equals another one of these contexts."""
    at = held.starts(WINDOW)
    context = np.repeat(np.arange(len(held.n)), held.n)
    starts = ranges(at[:-1], held.n.astype(np.int64))
    owner = np.full(len(held.symbols), -1, np.int32)
    owner[starts] = context
    hit = np.zeros(len(held.symbols) + 1, bool)
    for places, number in equal_windows(held.symbols, starts, WINDOW):
        count = np.bincount(number)
        hit[places[count[number] > 1]] = True
    found = np.flatnonzero(hit[:-1])
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    # windows side by side in one context make one stretch
    c = owner[found]
    new = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (c[1:] != c[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    lo = held.lo[c[first]] + found[first] - at[c[first]]
    return held.doc[c[first]], lo, lo + (found[last] - found[first]) + WINDOW


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for each row of ``docs``: bytes
    covered by a 200-byte string that also starts elsewhere are taken out of ``kept``
    (binary). A null text is empty; a row without an id keeps its text; identical
    rows are one document, rows of one id with different texts are documents of their own."""

    def apply(text, starts, ends):
        data = text.encode()
        kept, at = [], 0
        removed = 0
        for a, b in zip(starts.tolist(), np.minimum(ends, len(data)).tolist()):
            kept.append(data[at:a])
            removed += max(0, b - a)
            at = b
        kept.append(data[at:])
        return len(data), removed, len(starts), b"".join(kept)

    return with_removals(docs, SHAPE, find_equal, False, apply, "n_bytes long, n_removed long, n_spans long, kept binary")
