"""Periodic runs of words, found online by dyadic square catchers.

A *run* is a longest stretch of words with smallest period q and at least two periods.
Its first period holds a whole aligned block of about q/4 to q/2 words, and that block
occurs again q words later. So for each power of two B a *catcher* watches every
completed block of B words while the next words are appended: once the newest B words
equal the block at a distance that belongs to the level, a square is caught. Squares of
neighbouring blocks at one distance merge into a chain; when the block after a chain
fails, suffix comparisons over halved blocks find the chain's exact ends, which gives a
run. Each appended word meets two catchers a level, however periodic the text is.

Windows of a power of two words are compared by hashes that double, and each run that
is reported is then confirmed word by word in bytes. Documents share a stream, parted by
marks that equal nothing; a document never meets another one's words.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.common import mix, ranges, runs_of, span_hashes, text_buffer, texts_of, word_spans

LEAST = 12  # words of the shortest run
APPENDED = 1 << 17  # words appended at a time
FIRST_BLOCK = 4  # block of the level that catches periods 1 to 3
_TURN = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.zeros((0, 3), np.int64)
Order = Callable[[int | None, int], np.ndarray | None]


class Kept:
    """Array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(self.n, len(more)) + 1024, self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Catcher:
    """One level: completed blocks of ``block`` words and the squares caught with them.

    The level catches periods from 2 to 4 blocks, the first level those below one block.
    """

    def __init__(self, block: int, first: bool = False):
        self.block, self.first = block, first
        self.done = 0  # word places whose window has been compared with the blocks
        self.open = _NONE  # period, first and last block start of the chains that may go on

    def caught(self, windows: np.ndarray) -> np.ndarray:
        """Periods and block starts of the squares that the windows from ``done`` on close."""
        place = np.arange(self.done, len(windows))
        row = place // self.block
        found = []
        for back in (0,) if self.first else (2, 3):
            start = (row - back) * self.block
            ok = (start >= 0) & (place > start)
            at = np.flatnonzero(ok) if self.first else slice(int(np.argmax(ok)) if ok.any() else len(ok), None)
            at = np.arange(len(place))[at]
            at = at[windows[place[at]] == windows[start[at]]]
            found.append(np.stack([place[at] - start[at], start[at]], 1))
        self.done = len(windows)
        return np.concatenate(found)

    def chains(self, new: np.ndarray, ended: bool) -> np.ndarray:
        """Period, first and last block start of the chains that can grow no more."""
        held = np.concatenate([self.open, new[:, [0, 1, 1]]])
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        q, first, last = held.T
        head = np.ones(len(held), bool)
        head[1:] = (q[1:] != q[:-1]) | (first[1:] != last[:-1] + self.block)
        tail = np.append(head[1:], True)[: len(held)]
        held = np.stack([q[head], first[head], last[tail]], 1)
        shut = ended | (held[:, 2] + self.block + held[:, 0] < self.done)
        self.open = held[~shut]
        return held[shut]


class Stream:
    """Words appended one stretch after another; runs come out once no word can extend them.

    ``longest`` bounds the words of a document, so that no level is kept in vain. Words are
    unsigned 64-bit values; a document has to end with a value found nowhere else.
    """

    def __init__(self, longest: int):
        self.n = 0
        self.catchers = [Catcher(FIRST_BLOCK, True)]
        block = 2
        while 4 * block <= longest:  # two periods of at least two blocks
            self.catchers.append(Catcher(block))
            block *= 2
        most = max(c.block for c in self.catchers)
        self.windows = [Kept(np.uint64) for _ in range(most.bit_length())]  # by log2 of their words

    def append(self, words: np.ndarray, ended: bool = False) -> np.ndarray:
        """Rows of start, end and period of runs known now (may repeat a run with
        multiples of its period; see :func:`merged`)."""
        self.n += len(words)
        self.windows[0].extend(words)
        for k in range(1, len(self.windows)):
            half, low, own = 1 << (k - 1), self.windows[k - 1].values, self.windows[k]
            more = low[own.n : max(own.n, len(low) - half)] * _TURN + low[own.n + half :][: max(0, len(low) - half - own.n)]
            own.extend(mix(more))
        out = [self._runs(c, c.chains(c.caught(self.windows[c.block.bit_length() - 1].values), ended)) for c in self.catchers]
        return np.concatenate(out)

    def _runs(self, catcher: Catcher, chains: np.ndarray) -> np.ndarray:
        q, left, right = chains[:, 0], chains[:, 1].copy(), chains[:, 2] + catcher.block
        half = catcher.block // 2
        while half:
            w = self.windows[half.bit_length() - 1].values
            last = len(w) - 1
            equal = (left >= half) & (w[np.maximum(left - half, 0)] == w[np.clip(left - half + q, 0, last)])
            left -= half * equal
            equal = (right + q <= last) & (w[np.minimum(right, last)] == w[np.minimum(right + q, last)])
            right += half * equal
            half //= 2
        long = right - left + q >= np.maximum(LEAST, 2 * q)
        return np.stack([left, right + q, q], 1)[long]


def merged(runs: np.ndarray) -> np.ndarray:
    """Each stretch once with its smallest period, by start and period: a stretch with
    period q has the multiples of q for periods too."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def caught(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs (start, end, period; places in ``words``) of the texts that ``at`` parts. Texts
    of like length share a stream."""
    n = np.diff(at)
    size = np.frexp(n.astype(np.float64))[1]
    out = [_NONE]
    for s in np.unique(size[n >= LEAST]):
        texts = np.flatnonzero(size == s)
        length = n[texts] + 1
        first = np.concatenate(([0], np.cumsum(length)))
        values = np.empty(first[-1], np.uint64)
        marks = first[1:] - 1
        values[marks] = np.arange(len(texts), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        inside = np.ones(len(values), bool)
        inside[marks] = False
        values[inside] = words[ranges(at[texts], n[texts])] & ~np.uint64(1)
        stream = Stream(int(n[texts].max()))
        found = [stream.append(values[i : i + APPENDED], i + APPENDED >= len(values)) for i in range(0, len(values), APPENDED)]
        runs = merged(np.concatenate(found))
        if len(runs):
            owner = np.searchsorted(first, runs[:, 0], "right") - 1
            runs[:, :2] += (at[texts] - first[:-1])[owner, None]
            out.append(runs)
    return np.concatenate(out)


def confirmed(runs: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
    """Whether every run lies in one text and repeats byte for byte."""
    owner = np.searchsorted(at, runs[:, 0], "right") - 1
    if (runs[:, 1] > at[owner + 1]).any():
        return False
    for i in range(0, len(runs), 4096):
        a, b, q = runs[i : i + 4096].T
        here = ranges(a, b - a - q)
        there = here + np.repeat(q, b - a - q)
        size = ends[here] - starts[here]
        if (size != ends[there] - starts[there]).any():
            return False
        for j in range(0, len(here), 1 << 18):
            x, y, z = here[j : j + (1 << 18)], there[j : j + (1 << 18)], size[j : j + (1 << 18)]
            if (data[ranges(starts[x], z)] != data[ranges(starts[y], z)]).any():
                return False
    return True


def word_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Confirmed runs of texts whose words are spans of ``data`` with hashes ``words``. Should
    hashes have made different words equal, words are numbered exactly and hashed anew."""
    runs, turn = caught(words, at), 0
    while not confirmed(runs, at, data, starts, ends):
        turn += 1
        raw, numbers = data.tobytes(), {}
        exact = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())]
        words = mix(np.array(exact, np.uint64) * np.uint64(2) + np.uint64(turn << 40))
        runs = caught(words, at)
    return runs


def runs_per_text(batch: pa.RecordBatch, order: Order | None = None):
    """For each row of ``doc_id, text``: its words, its runs as rows of start, end and period,
    and a mask of the words kept."""
    ids = batch.column(0).to_pylist()
    data, off = text_buffer(batch.column(1))
    starts, ends, at = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    moved = {}
    if order:
        for k, doc in enumerate(ids):
            own = order(doc, int(at[k + 1] - at[k]))
            if own is not None:
                moved[k] = own
        if moved:
            place = np.arange(len(starts))
            for k, own in moved.items():
                place[at[k] : at[k + 1]] = at[k] + own
            starts, ends, words = starts[place], ends[place], words[place]
    runs = word_runs(data, starts, ends, words, at)
    owner = np.searchsorted(at, runs[:, 0], "right") - 1
    runs = runs[np.argsort(owner, kind="stable")]
    cut = np.searchsorted(np.sort(owner), np.arange(len(ids) + 1))
    raw = data.tobytes()
    for k in range(len(ids)):
        own = runs[cut[k] : cut[k + 1]].copy()
        own[:, :2] -= at[k]
        held = raw[off[k] : off[k + 1]].split()  # bytes.split() parts at the same six bytes
        if k in moved:
            held = [held[i] for i in moved[k].tolist()]
        keep = np.ones(len(held), bool)
        if len(own):
            depth = np.zeros(len(held) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 1], -1)
            keep = np.cumsum(depth[:-1]) == 0
        yield held, own, keep


def find_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed`` for each row
    of ``docs``.

    ``start``, ``length``, ``period`` tell of the longest run (ties: smallest start, then
    period; null without any), ``runs`` lists all of them as lines ``start,length,period`` by
    start and period, and ``collapsed`` has the words outside runs and each run's first
    period, joined by one space. ``order(doc_id, n)`` may give other places for a text's n
    words (a test's way to plant runs). A null text has no words, a text without words no
    runs and an empty ``collapsed``; rows are taken one by one, so repeated ids and rows
    without an id are like any other, and other columns are left out.
    """
    names = "doc_id n_runs start length period exponent_milli runs collapsed".split()

    def apply(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, (held, own, keep) in zip(batch.column(0).to_pylist(), runs_per_text(batch, order)):
                best = (None,) * 4
                if len(own):
                    size = own[:, 1] - own[:, 0]
                    i = int(np.argmax(size))  # runs are by start, then period
                    a, n, q = int(own[i, 0]), int(size[i]), int(own[i, 2])
                    best = a, n, q, 1000 * n // q
                lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in own.tolist())
                kept = held if keep.all() else [held[i] for i in np.flatnonzero(keep).tolist()]
                for column, value in zip(out, (doc, len(own), *best, lines, b" ".join(kept).decode())):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    longs = ", ".join(f"{n} long" for n in names[:6])
    return texts_of(docs).mapInArrow(apply, f"{longs}, runs string, collapsed string")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of a text's words after a run has been planted by rule into a tenth of the
    documents; none where the text stays as it is (also without an id)."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place
