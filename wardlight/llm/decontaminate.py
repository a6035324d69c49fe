"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Items and texts are compared in a plain form: lower case, runs of ASCII white space
and punctuation as one space. An item is looked for in segments of ``SEGMENT`` bytes
that start every ``STRIDE`` bytes, so a passage of ``SEGMENT + STRIDE - 1`` bytes holds a
whole one wherever it starts. A segment of length L that lies
in a text with at most e edits shares at least L + 1 - q * (e + 1) q-grams with it,
all in a band of e + 1 diagonals. Texts are looked up q-gram by q-gram in the items'
q-grams; stretches with enough hits are counted per segment in diagonal bands that
overlap by half; bands that reach the bound are aligned, and leaks need e edits or less.
Items too short for that are looked for as they are, as whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import LOWER, part_of, parts_for, ranges, slices, text_buffer, total_bytes

Q = 8
SEGMENT, BUDGET = 120, 0.075
STRIDE = 9  # no more than a segment's edits, so an exact passage of SEGMENT bytes is found too
SHORTEST = 40  # bytes in plain form; shorter items are matched whole and without edits
SHARD_BYTES = 4 << 20  # item text held by a task at a time
ALIGNED = 4096  # alignments done at once
RUN_BYTES = 512 << 10  # text searched at once; a search holds some sixty bytes for each byte of it
_BITS = 22
_AHEAD = 1 << 32  # added to diagonals, which are never negative then
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain bytes of each text, their offsets, and where each byte came from."""
    text = _PLAIN[data]
    # capital letters of Latin-1 follow the byte C3
    if len(data) > 1:
        big = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        text[big] += 32
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = off[:-1][off[:-1] < len(text)]
    keep[first] = ~space[first]  # no space opens a text
    came = np.flatnonzero(keep)
    return text[came], np.searchsorted(came, off), came


def grams(text: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each place as one number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", np.ascontiguousarray(text).data, strides=(1,)).astype(np.uint64)


def budget(length: int) -> int:
    return int(BUDGET * length)


def bound(length: int) -> int:
    """Fewest q-grams shared within the budget."""
    return length + 1 - Q * (budget(length) + 1)


@dataclass
class Segments:
    """Segments of a shard of items and the index of their q-grams."""

    item: np.ndarray
    length: np.ndarray
    body: np.ndarray  # plain bytes of all items, SEGMENT zeros at the end
    start: np.ndarray  # of each segment in ``body``
    own: np.ndarray  # first segment of each item
    at: np.ndarray  # where each item's bytes start
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # entries of each q-gram
    entry: np.ndarray  # item's number << 32 | place in the item
    seen: np.ndarray  # table by hashed q-gram
    short: dict[int, tuple[np.ndarray, list[list[tuple[int, bytes]]]]]  # by bytes of the key: keys, short items

    @property
    def text(self) -> np.ndarray:
        """One row a segment, zeros after its end."""
        places = np.arange(SEGMENT)
        return np.where(places < self.length[:, None], self.body[self.start[:, None] + places], 0).astype(np.uint8)

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Segments:
        bodies, owner, length, start, own, at = [], [], [], [], [], []
        short: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
        total = 0
        for item, text in items:
            data, off = text_buffer(pa.array([text], pa.string()))
            body = plain(data, off)[0]
            while len(body) and body[-1] == 32:
                body = body[:-1]
            if len(body) < SHORTEST:
                if len(body):
                    key = body.tobytes()[:Q]
                    short.setdefault(len(key), {}).setdefault(int.from_bytes(key, "little"), []).append((item, body.tobytes()))
                continue
            last = max(0, len(body) - SEGMENT)
            own.append(len(start))
            at.append(total)
            for a in sorted({*range(0, last, STRIDE), last}):
                owner.append(item)
                start.append(total + a)
                length.append(min(len(body), SEGMENT))
            bodies.append(body)
            total += len(body)
        found = [grams(b) for b in bodies]
        gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
        entry = np.concatenate([(i << 32) + np.arange(len(g)) for i, g in enumerate(found)]) if found else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        keys, first = np.unique(gram[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(keys)] = True
        whole = lambda x: np.array(x, np.int64)
        return cls(
            whole(owner), whole(length), np.concatenate([*bodies, np.zeros(SEGMENT, np.uint8)]), whole(start),
            np.append(whole(own), len(start)), whole(at), keys, np.append(first, len(gram)), entry[order], seen,
            {n: (np.array(sorted(x), np.uint64), [x[k] for k in sorted(x)]) for n, x in short.items()},
        )


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)


def candidates(segments: Segments, text: np.ndarray, off: np.ndarray):
    """Segment, first diagonal of a band, and text (as a row) of every band that
    reaches the bound. Diagonals count from the start of ``text``."""
    none = (np.zeros(0, np.int64),) * 3
    gram = grams(text)
    if not len(gram) or not len(segments.keys):
        return none
    hit = segments.seen[_slot(gram)]
    # a leak's stretch holds at least the least bound of all segments
    need = int(min(bound(int(n)) for n in np.unique(segments.length)))
    reach = int(segments.length.max()) + 2 * budget(int(segments.length.max())) + 1
    sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    ahead = np.minimum(np.arange(len(hit)) + reach, len(hit))
    at = np.flatnonzero(hit)
    # a hit stays if some window over it is full enough
    full = np.flatnonzero(sums[ahead] - sums[:-1] >= need)
    if not len(full):
        return none
    mark = np.zeros(len(hit) + 1, np.int32)
    np.add.at(mark, full, 1)
    np.add.at(mark, np.minimum(full + reach, len(hit)), -1)
    at = at[np.cumsum(mark)[at] > 0]
    key = np.minimum(np.searchsorted(segments.keys, gram[at]), len(segments.keys) - 1)
    real = segments.keys[key] == gram[at]
    at, key = at[real], key[real]
    if not len(at):
        return none
    count = segments.first[key + 1] - segments.first[key]
    entry = segments.entry[ranges(segments.first[key], count)]
    item, place = entry >> 32, entry & 0xFFFFFFFF
    at = np.repeat(at, count)
    row = np.searchsorted(off, at, "right") - 1
    inside = at + Q <= off[row + 1]  # a q-gram over two texts is none
    item, place, at, row = item[inside], place[inside], at[inside], row[inside]
    length = segments.length[segments.own[:-1]]  # segments of an item have one length
    step = (BUDGET * length).astype(np.int64) + 1
    least = length + 1 - Q * step
    diagonal = at - place + _AHEAD
    out: list = []
    for turn in (0, 1):  # bands of two steps, one step apart
        band = (diagonal // step[item] - turn) // 2
        order = np.lexsort((place, band, item, row))
        code = np.stack([row, item, band])[:, order]
        new = np.ones(code.shape[1], bool)
        new[1:] = (code[:, 1:] != code[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, code.shape[1]))
        full = np.flatnonzero(size >= least[code[1, first]])  # else none of the item's segments is
        first, size = first[full], size[full]
        group = np.repeat(np.arange(len(first)), size)
        spot = (group << 32) + place[order][ranges(first, size)]  # hits by band and place in the item
        r, i, b = code[:, first]
        each = segments.own[i + 1] - segments.own[i]
        segment, group = ranges(segments.own[i], each), np.repeat(np.arange(len(first)), each)
        i = i[group]
        start = segments.start[segment] - segments.at[i]
        low = (group << 32) + start
        total = np.searchsorted(spot, low + length[i] - Q + 1) - np.searchsorted(spot, low)
        good = total >= least[i]
        segment, group, i, start = segment[good], group[good], i[good], start[good]
        out.append((segment, (2 * b[group] + turn) * step[i] - _AHEAD + start, r[group]))
    return tuple(np.concatenate(x) for x in zip(*out))


def whole_items(segments: Segments, text: np.ndarray, off: np.ndarray):
    """``row, item, start, end`` of the short items that texts hold as whole words."""
    raw, out = text.tobytes(), []
    wide = grams(np.append(text, np.zeros(Q, np.uint8)))[: len(text)]
    opens = np.ones(len(text), bool)
    opens[1:] = text[:-1] == 32
    opens[off[:-1][off[:-1] < len(text)]] = True
    opens = np.flatnonzero(opens)
    for n, (keys, items) in segments.short.items():
        gram = wide[opens] & np.uint64((1 << 8 * n) - 1)
        key = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        hit = np.flatnonzero(keys[key] == gram)
        rows = np.searchsorted(off, opens[hit], "right") - 1
        for a, k, row in zip(opens[hit].tolist(), key[hit].tolist(), rows.tolist()):
            for item, body in items[k]:
                b = a + len(body)
                if b <= off[row + 1] and raw.startswith(body, a) and (b == off[row + 1] or raw[b] == 32):
                    out.append((row, item, a, b))
    return np.array(out, np.int64).reshape(-1, 4).T


def align(segments: Segments, text: np.ndarray, off, segment, diagonal, row):
    """Fewest edits of each candidate in its band, and where the match ends."""
    edits, ends = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
    for b in range(0, len(segment), ALIGNED):
        s, d, r = segment[b : b + ALIGNED], diagonal[b : b + ALIGNED], row[b : b + ALIGNED]
        length = segments.length[s]
        slack = (BUDGET * length).astype(np.int64)
        origin = d - slack
        width = int((2 * (slack + 1) + 2 * slack).max()) + 1
        k = np.arange(width)
        cost = np.zeros((len(s), width), np.int32)
        low, high = off[r][:, None], off[r + 1][:, None]
        for j in range(int(length.max())):
            spot = origin[:, None] + j + k
            inside = (spot >= low) & (spot < high)
            there = np.where(inside, text[np.clip(spot, 0, len(text) - 1)], 0)
            new = cost + (there != segments.body[segments.start[s] + j][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.minimum.accumulate(new - k, axis=1) + k
            cost = np.where((j < length)[:, None], new, cost)
        best = cost.argmin(axis=1)
        edits[b : b + ALIGNED] = cost[np.arange(len(s)), best]
        ends[b : b + ALIGNED] = np.clip(origin + length + best, off[r], off[r + 1])
    return edits, ends


def leaks(segments: Segments, data: np.ndarray, off: np.ndarray):
    """``row, item, start, end, edits`` of the leaks in a run of texts, one for each
    text and item; start and end are bytes of the text, around all its matches."""
    text, at, came = plain(data, off)
    row, item, starts, ends = whole_items(segments, text, at)
    edits = np.zeros(len(row), np.int64)
    segment, diagonal, there = candidates(segments, text, at)
    if len(segment):
        cost, last = align(segments, text, at, segment, diagonal, there)
        length = segments.length[segment]
        good = cost <= (BUDGET * length).astype(np.int64)
        segment, there, cost, last, length = (x[good] for x in (segment, there, cost, last, length))
        row, item = np.append(row, there), np.append(item, segments.item[segment])
        starts, ends = np.append(starts, np.maximum(last - length, at[there])), np.append(ends, last)
        edits = np.append(edits, cost)
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    order = np.lexsort((item, row))
    code = np.stack([row, item])[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (code[:, 1:] != code[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(starts[order], first)
    high = np.maximum.reduceat(ends[order], first)
    row, item = code[:, first]
    return (row, item, came[low] - off[row], came[high - 1] + 1 - off[row],
            np.minimum.reduceat(edits[order], first))


def searched(segments: Segments, column):
    """Runs of the texts of a column with their leaks: number of the first text, bytes, offsets,
    :func:`leaks`."""
    data, off = text_buffer(column)
    for i, j in slices(off, RUN_BYTES):
        mine, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield i, mine, cut, leaks(segments, mine, cut)


def _shards(benchmark: DataFrame) -> list[DataFrame]:
    """Items with a text and an id, in shards of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    n = parts_for(total_bytes(items), SHARD_BYTES)
    return [items.where(part_of("item_id", n) == k) for k in range(n)]


def _segments(shard: DataFrame) -> Segments:
    # at most about SHARD_BYTES of text
    return Segments.of(sorted((r.item_id, r.text) for r in shard.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: a row for each document and item of
    which it holds a passage; start and end are code points around its matches, edits
    those of the best one. Null and empty texts hold none. A benchmark above one
    shard is searched shard by shard, each in a pass of its own."""
    found = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for shard in _shards(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(_segments(shard))

        def search(batches, held=held):
            for batch in batches:
                for i, mine, cut, (row, item, start, end, edits) in searched(held.value, batch.column(1)):
                    if not len(row):
                        continue
                    points = lambda upto: [
                        int(((mine[cut[r] : cut[r] + b] & 0xC0) != 0x80).sum()) for r, b in zip(row, upto)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + i)), pa.array(item, pa.int64()),
                         pa.array(points(start), pa.int64()), pa.array(points(end), pa.int64()), pa.array(edits, pa.int64())],
                        ["doc_id", "item_id", "start", "end", "edits"],
                    )

        part = rows.mapInArrow(search, "doc_id long, item_id long, start long, end long, edits long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item, unchanged."""
    at = docs.columns.index("text")
    for shard in _shards(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(_segments(shard))

        def keep(batches, held=held):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, _, (row, *_) in searched(held.value, batch.column(at)):
                    clean[row + i] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, T.StructType(list(docs.schema.fields)))
    return docs
