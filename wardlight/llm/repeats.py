"""Windows of a corpus that occur again: what the two substring operators share.

A window is ``window`` consecutive symbols (bytes, or words) of one text. Sorting all
suffixes of a corpus would move every one of them, so only suffixes that can belong
to a repeated window are sorted, and none is lost:

1. Each window is assigned to its *anchor*, the run of ``gram`` symbols inside it
   with the smallest hash, leftmost on ties. Equal windows have equal anchors at
   equal distance. Anchors are a few per window; their hashes meet in buckets, and
   those found once are dropped with all their windows.
2. For each anchor that is left, the text that its windows cover, a *context*, goes
   to a bucket by the anchor's hash. Equal contexts of a batch travel once.
3. A bucket holds every pair of equal windows of its anchors. The operator's own
   suffix structure finds them there, and covered stretches return to their documents.

Anchors found more than ``hot`` times send hashes of single windows instead of
contexts, dealt out by those hashes, so that no bucket has to hold a hot anchor.

Rows with equal ids and texts are one document given twice. Rows of one id with different texts are
documents of their own, in the order of 31 bits of the texts' hash: their places begin at that number
times 2**32, which no text's length reaches. Rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import (
    blob, joined, mix, part_of, parts_for, parts_of_ids, ranges, runs_of, span_hashes, text_buffer, texts_of, total_bytes, word_spans, written,
)

BLOCK_WINDOWS = 1 << 20
BUCKET_BYTES = 16 << 20  # text per anchor bucket
PART_BYTES = 8 << 20  # text per document part, and per context bucket
HOT = 200_000  # occurrences of an anchor; rises with the text, so that hot anchors number a million at most
HOT_BYTES = 50_000_000
LONGS = pa.list_(pa.int64())
_PLACE = np.uint64((1 << 24) - 1)
_TERMS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(64)]


@dataclass(frozen=True)
class Shape:
    """Sizes in symbols; ``kind`` is the symbol type."""

    window: int
    gram: int
    kind: type
    hot: int = HOT

    def symbols(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a run of texts and where each text starts."""
        if self.kind is np.uint8:
            return data, off
        starts, ends, at = word_spans(data, off)
        return span_hashes(data, starts, ends).astype(np.uint32), at


def run_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` symbols."""
    m = max(0, len(symbols) - n + 1)
    h = np.zeros(m, np.uint64)
    if not m:
        return h
    if symbols.dtype == np.uint8:  # eight bytes at a time, the last ones overlapping
        wide = np.ndarray((len(symbols) - 7,), "<u8", np.ascontiguousarray(symbols).data, strides=(1,))
        steps = [*range(0, n - 8, 8), n - 8]
        for k, s in enumerate(steps):
            h ^= h >> np.uint64(29)
            h += wide[s : s + m] * _TERMS[k]
            h *= _TERMS[k + 1]
    else:
        for k in range(n):
            h *= _TERMS[0]
            h += symbols[k : k + m]
    return mix(h)


def anchors(shape: Shape, symbols: np.ndarray, off: np.ndarray):
    """For each anchor: hash, place, and the first and last start of its windows
    (places count from the first symbol of the run of texts)."""
    w = shape.window - shape.gram + 1
    n = len(symbols) - shape.window + 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    if n > 0:
        tail = np.maximum(off[1:] - shape.window + 1, off[:-1])
        crossing = ranges(tail, off[1:] - tail)
        inside = np.ones(len(symbols), bool)
        inside[crossing] = False
        for b in range(0, n, BLOCK_WINDOWS):
            e = min(n, b + BLOCK_WINDOWS)
            starts = np.flatnonzero(inside[b:e])
            if not len(starts):
                continue
            hashes = run_hashes(symbols[b : e + shape.window - 1], shape.gram)
            least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
            span = 1
            while span * 2 <= w:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < w:
                least = np.minimum(least[: e - b], least[w - span : w - span + e - b])
            place = (least[starts] & _PLACE).astype(np.int64)
            # a run: one anchor, windows side by side
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            out[0].append(hashes[place[first]])
            out[1].append(place[first] + b)
            out[2].append(starts[first] + b)
            out[3].append(starts[last] + b)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds)]


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]):
    """Order by bucket; yields each bucket with its rows of the columns."""
    order = np.argsort(bucket, kind="stable")
    first, length = runs_of(bucket[order])
    for a, n in zip(first, length):
        pick = order[a : a + n]
        yield int(bucket[pick[0]]), [c[pick] for c in columns]


def _modulo(values: np.ndarray, n: int) -> np.ndarray:
    return (values % np.uint64(n)).astype(np.int32)


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base``; ``base`` is the number of a text's first place."""
    return texts_of(docs).withColumn("base", F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 33), 32))


def _shared_anchors(texts: DataFrame, shape: Shape, buckets: int, hot: int) -> DataFrame:
    """``doc_id, marks``: places of the anchors found more than once. Rows without a
    document hold in ``hot`` the hashes of anchors found more than ``hot`` times."""

    def scan(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            symbols, at = shape.symbols(data, off)
            h, place, _, _ = anchors(shape, symbols, at)
            if not len(h):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row = np.searchsorted(at, place, "right") - 1
            base = batch.column(2).to_numpy(zero_copy_only=False)
            doc, pos = ids[row].astype(np.int64), place - at[row] + base[row]
            order = np.lexsort((pos, doc, h))
            h, doc, pos = h[order], doc[order], pos[order]
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
            h, doc, pos = h[fresh], doc[fresh], pos[fresh]
            first, length = runs_of(h)
            # one of each anchor is looked up; where the batch has several, all are known to be shared
            several = np.repeat(length > 1, length)
            count = np.concatenate((length, np.zeros(int(several.sum()), np.int64))).astype(np.int32)
            rows = [
                np.concatenate((h[first], h[several])), np.concatenate((doc[first], doc[several])),
                np.concatenate((pos[first], pos[several])), count,
            ]
            bucket = np.concatenate((_modulo(h[first], buckets), parts_of_ids(doc[several], buckets)))
            for b, (x, d, p, c) in by_bucket(bucket, rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), *(pa.array([blob(v)], pa.binary()) for v in (x, d, p, c))],
                    ["bucket", "h", "doc", "pos", "n"],
                )

    def meet(table: pa.Table) -> pa.Table:
        h, doc = joined(table.column("h"), np.uint64), joined(table.column("doc"), np.int64)
        pos, n = joined(table.column("pos"), np.int64), joined(table.column("n"), np.int32)
        known = n == 0
        asked = np.flatnonzero(~known)
        asked = asked[np.lexsort((pos[asked], doc[asked], h[asked]))]
        ah, ad, ap = h[asked], doc[asked], pos[asked]
        first, length = runs_of(ah)
        group = np.repeat(np.arange(len(first)), length)
        other = np.concatenate(([False], (ah[1:] == ah[:-1]) & ((ad[1:] != ad[:-1]) | (ap[1:] != ap[:-1]))))
        total = np.bincount(group, n[asked], len(first)) if len(first) else np.zeros(0)
        distinct = np.bincount(group, other, len(first)) + 1 if len(first) else np.zeros(0)
        most = np.zeros(len(first), np.int64)
        np.maximum.at(most, group, n[asked])
        shared = ((distinct > 1) | (most > 1))[group] if len(first) else np.zeros(0, bool)
        often = ah[first[total > hot]].view(np.int64)
        d = np.concatenate((ad[shared], doc[known]))
        m = np.concatenate((ap[shared], pos[known]))
        order = np.argsort(d, kind="stable")
        d, m = d[order], m[order]
        first, length = runs_of(d)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)).astype(np.int32)), pa.array(m, pa.int64()))
        out = pa.table({"doc_id": pa.array(d[first], pa.int64()), "marks": lists, "hot": pa.nulls(len(first), LONGS)})
        if not len(often):
            return out
        row = {"doc_id": pa.nulls(1, pa.int64()), "marks": pa.nulls(1, LONGS), "hot": pa.array([often], LONGS)}
        return pa.concat_tables([out, pa.table(row)])

    found = texts.mapInArrow(scan, "bucket int, h binary, doc binary, pos binary, n binary")
    return found.groupBy("bucket").applyInArrow(meet, "doc_id long, marks array<long>, hot array<long>")


@dataclass
class Contexts:
    """Contexts of one bucket: anchor hash, document, first window start, distance
    of the anchor from it, number of windows, whether its batch held it twice, and
    all symbols one after the other."""

    h: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    left: np.ndarray
    n: np.ndarray
    twice: np.ndarray
    symbols: np.ndarray

    def starts(self, window: int) -> np.ndarray:
        size = self.n + window - 1
        return np.concatenate(([0], np.cumsum(size)))


Stretches = tuple[np.ndarray, np.ndarray, np.ndarray]  # document, start, end
_COLUMNS = ["h", "doc", "lo", "left", "n", "twice", "symbols", "c_doc", "c_from", "c_to"]
_KINDS = [np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8]


def covered(docs: DataFrame, shape: Shape, find: Callable[[Contexts], Stretches], keep_first: bool) -> DataFrame:
    """``part, doc, lo, hi``: per bucket and document part the stretches of symbols
    to remove, as arrays in blobs. With ``keep_first`` the earliest of equal windows
    stays (smaller id, then earlier start), otherwise none. ``find`` gets contexts
    that differ from each other and returns the stretches of their equal windows.
    """
    texts = placed(docs).where(F.col("doc_id").isNotNull())
    size = total_bytes(texts)
    parts, buckets = parts_for(size, PART_BYTES), parts_for(size, PART_BYTES)
    limit = max(shape.hot, size // HOT_BYTES)
    marks = written(_shared_anchors(texts, shape, parts_for(size, BUCKET_BYTES), limit), "shared-anchors")
    often = [h for r in marks.where("doc_id IS NULL").collect() for h in r.hot]
    hot_hashes = np.array(often, np.int64).view(np.uint64)
    marks = marks.where("doc_id IS NOT NULL").select("doc_id", "marks", part_of("doc_id", parts).alias("__part"))

    def cut(table: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = {"bucket": pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in _COLUMNS}
        if not wanted.num_rows or not table.num_rows:
            return pa.table(empty)
        asked: dict[int, list] = {}
        for doc, m in zip(wanted.column("doc_id").to_pylist(), wanted.column("marks")):
            asked.setdefault(doc, []).append(m.values.to_numpy(zero_copy_only=False))
        ids = table.column("doc_id").to_numpy()
        table = table.filter(pa.array(np.isin(ids, np.fromiter(asked, np.int64, len(asked)))))
        rows: dict[str, list] = {c: [] for c in ["bucket", *_COLUMNS]}
        done: set[tuple[int, int]] = set()
        for batch in table.to_batches(max_chunksize=500):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            base = batch.column(batch.schema.get_field_index("base")).to_numpy(zero_copy_only=False)
            data, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            symbols, at = shape.symbols(data, off)
            first = at[:-1] - base
            h, place, lo, hi = anchors(shape, symbols, at)
            row = np.searchsorted(at, place, "right") - 1
            found = np.zeros(len(h), bool)
            hot = np.isin(h, hot_hashes)
            edge = np.searchsorted(row, np.arange(len(ids) + 1))
            for r, doc in enumerate(zip(ids.tolist(), base.tolist())):
                if doc in done:  # the same document once more
                    continue
                done.add(doc)
                a, b = edge[r], edge[r + 1]
                mine = np.concatenate(asked[doc[0]])
                found[a:b] = np.isin(place[a:b] - first[r], mine)
            _emit(rows, shape, symbols, first, ids, h[found], place[found], lo[found], hi[found], row[found], hot[found],
                  buckets, keep_first)
        return pa.table(
            {"bucket": pa.array(rows["bucket"], pa.int32())} | {c: pa.array(rows[c], pa.binary()) for c in _COLUMNS}
        )

    def meet(table: pa.Table) -> pa.Table:
        h, doc, lo, left, n, twice = (joined(table.column(c), k) for c, k in zip(_COLUMNS, _KINDS))
        held = Contexts(h, doc, lo, left, n, twice.astype(bool), joined(table.column("symbols"), shape.kind))
        cover = [tuple(joined(table.column(c), np.int64) for c in _COLUMNS[7:])]
        cover += _settled(held, shape, keep_first, find)
        d, a, b = (np.concatenate(x) for x in zip(*cover))
        out: dict[str, list] = {"part": [], "doc": [], "lo": [], "hi": []}
        for p, columns in by_bucket(parts_of_ids(d, parts), [d, a, b]):
            out["part"].append(p)
            for name, values in zip(("doc", "lo", "hi"), columns):
                out[name].append(blob(values))
        return pa.table({"part": pa.array(out["part"], pa.int32())} | {
            c: pa.array(out[c], pa.binary()) for c in ("doc", "lo", "hi")
        })

    contexts = (
        texts.withColumn("__part", part_of("doc_id", parts)).groupBy("__part").cogroup(marks.groupBy("__part"))
        .applyInArrow(cut, "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS))
    )
    return contexts.groupBy("bucket").applyInArrow(meet, "part int, doc binary, lo binary, hi binary")


def _emit(rows, shape, symbols, first_place, ids, h, place, lo, hi, row, hot, buckets, keep_first) -> None:
    """Contexts of a batch by bucket; equal ones once, with the stretches that are
    settled by it. A symbol's place in its document is its index less ``first_place``."""
    if not len(h):
        return
    window = shape.window
    if hot.any():  # one context per window, found again by the window's hash
        single = ranges(lo[hot], hi[hot] - lo[hot] + 1)
        times = (hi[hot] - lo[hot] + 1)
        h = np.concatenate((h[~hot], run_hashes(symbols, window)[single]))
        row = np.concatenate((row[~hot], np.repeat(row[hot], times)))
        place = np.concatenate((place[~hot], single))
        hi = np.concatenate((hi[~hot], single))
        lo = np.concatenate((lo[~hot], single))
    n, left = hi - lo + 1, place - lo
    whole = context_hashes(symbols, lo, n + window - 1) ^ mix(h + left.astype(np.uint64) * np.uint64(0x10001))
    doc, start = ids[row].astype(np.int64), lo - first_place[row]
    order = np.lexsort((start, doc, whole))
    first, length = runs_of(whole[order])
    rest = np.ones(len(order), bool)
    rest[first] = False  # the earliest of equal ones travels
    settled = order[rest] if keep_first else order[np.repeat(length > 1, length)]
    sent, twice = order[first], (length > 1).astype(np.uint8)
    bucket = _modulo(h[sent], buckets)
    values = [h[sent], doc[sent], start[sent], left[sent].astype(np.int32), n[sent].astype(np.int32), twice, lo[sent]]
    for b, (*columns, where) in by_bucket(bucket, values):
        rows["bucket"].append(b)
        for c, v in zip(_COLUMNS, columns):
            rows[c].append(blob(v))
        rows["symbols"].append(blob(symbols[ranges(where, columns[4].astype(np.int64) + window - 1)]))
        for c in _COLUMNS[7:]:
            rows[c].append(None)
    cover = [doc[settled], start[settled], start[settled] + n[settled] + window - 1]
    for b, columns in by_bucket(parts_of_ids(cover[0], buckets), cover):
        rows["bucket"].append(b)
        for c in _COLUMNS[:7]:
            rows[c].append(None)
        for c, v in zip(_COLUMNS[7:], columns):
            rows[c].append(blob(v))


def context_hashes(symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each stretch of symbols, any lengths of at least eight bytes."""
    wide = symbols if symbols.dtype == np.uint8 else symbols.view(np.uint8)
    scale = symbols.dtype.itemsize
    a, n = first * scale, length * scale
    eights = np.ndarray((max(0, len(wide) - 7),), "<u8", np.ascontiguousarray(wide).data, strides=(1,))
    whole = -(-n // 8)
    step = ranges(np.zeros(len(a), np.int64), whole)
    spot = np.repeat(a, whole) + np.minimum(step * 8, np.repeat(n, whole) - 8)
    value = mix(eights[spot] + step.astype(np.uint64) * _TERMS[3])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    end = np.cumsum(whole)
    return mix(sums[end] - sums[end - whole] + n.astype(np.uint64))


def _settled(held: Contexts, shape: Shape, keep_first: bool, find) -> list[Stretches]:
    """Equal contexts are settled here; one of each, where an anchor has several,
    goes to ``find``."""
    if not len(held.h):
        return []
    window, at = shape.window, held.starts(shape.window)
    size = held.n + window - 1
    whole = context_hashes(held.symbols, at[:-1], size.astype(np.int64)) ^ mix(
        held.h + held.left.astype(np.uint64) * np.uint64(0x10001)
    )
    order = np.lexsort((held.lo, held.doc, whole, held.h))
    first, length = runs_of(whole[order])
    many = np.bincount(np.repeat(np.arange(len(first)), length), held.twice[order]) > 0
    many |= length > 1
    rest = np.ones(len(order), bool)
    rest[first] = False
    settled = order[rest] if keep_first else order[np.repeat(many, length)]
    out = [(held.doc[settled], held.lo[settled], held.lo[settled] + size[settled])]
    rep = order[first]
    group_first, group_length = runs_of(held.h[rep])
    several = np.repeat(group_length > 1, group_length)
    pick = rep[several]
    if len(pick):
        few = Contexts(
            held.h[pick], held.doc[pick], held.lo[pick], held.left[pick], held.n[pick], many[several],
            held.symbols[ranges(at[:-1][pick], size[pick].astype(np.int64))],
        )
        out.append(find(few))
    return out


def removals(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Merged stretches of each document from rows of ``covered``."""
    d, a, b = (joined(table.column(c), np.int64) for c in ("doc", "lo", "hi"))
    if not len(d):
        return {}
    order = np.lexsort((a, d))
    d, a, b = d[order], a[order], b[order]
    out = {}
    first, length = runs_of(d)
    for f, n in zip(first, length):
        s, e = a[f : f + n], np.maximum.accumulate(b[f : f + n])
        new = np.concatenate(([True], s[1:] > e[:-1]))
        starts = s[new]
        ends = e[np.append(np.flatnonzero(new)[1:] - 1, n - 1)]
        out[int(d[f])] = starts, ends
    return out


def with_removals(docs: DataFrame, shape: Shape, find, keep_first: bool, apply, schema: str) -> DataFrame:
    """``apply(text, starts, ends) -> tuple`` for every row of ``docs``, with the
    stretches to remove; ``schema`` names what it returns, after ``doc_id``."""
    texts = placed(docs)
    size = total_bytes(texts.where(F.col("doc_id").isNotNull()))
    parts = parts_for(size, PART_BYTES)
    gone = covered(docs, shape, find, keep_first)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(table: pa.Table, cover: pa.Table) -> pa.Table:
        stretches = removals(cover)

        def own(doc: int | None, base: int) -> tuple[np.ndarray, np.ndarray]:
            starts, ends = stretches.get(doc, none)
            a, b = np.searchsorted(starts, [base, base + (1 << 32)])
            return starts[a:b] - base, ends[a:b] - base

        given = zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "base")))
        rows = [(doc, *apply(text, *own(doc, base))) for doc, text, base in given]
        names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [pa.int64(), *(kinds[c.split()[1]] for c in schema.split(", "))]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    def untouched(batches):
        empty = pa.table({c: pa.array([], pa.binary()) for c in ("doc", "lo", "hi")})
        for batch in batches:
            yield from run(pa.Table.from_batches([batch]), empty).to_batches()

    # rows without an id lose nothing; they stay out of the groups, where all would meet in one
    named = texts.where("doc_id IS NOT NULL").withColumn("__part", part_of("doc_id", parts)).groupBy("__part")
    alone = texts.where("doc_id IS NULL").mapInArrow(untouched, f"doc_id long, {schema}")
    return named.cogroup(gone.groupBy("part")).applyInArrow(run, f"doc_id long, {schema}").unionByName(alone)
