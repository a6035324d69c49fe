"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its link classes.

A document's set is its distinct word shingles. Two documents link when
100 * intersection >= threshold * union; the result is the class of documents that
links connect, so copies are never expanded into pairs.

1. Documents with equal sets are one class at once and go on as one.
2. Every shingle's number of documents is counted exactly, up to rare clashes that
   only raise a count. Texts travel to parts, parts send their shingles to buckets as
   packed arrays, and buckets return a level for each.
3. A set of n links only if at least ceil(threshold * n) of its shingles are found
   elsewhere; other documents are done. Under the order of shingles by level, rare
   first, two linked sets share a shingle of their prefixes. Prefix shingles meet in
   buckets; each task sends one document per shingle, the others are tied to it, so a
   shingle in a third of all documents is a few rows. The ties' components are
   *candidate classes*: no link leaves one.
4. Sets of candidate classes travel once, to the class. There each document is
   searched in the inverted lists of its class: T-occurrence search merges the short
   lists with a heap and probes the long ones by binary search. Classes too large for
   a task are cut into cells of two blocks, each pair of blocks being one cell.
"""

from __future__ import annotations

import heapq
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import (
    blob, gram_hashes, joined, mix, parts_for, parts_of_ids, ranges, runs_of, span_hashes, text_buffer, texts_of,
    total_bytes, word_spans, written,
)
from wardlight.llm.components import components
from wardlight.plans.sizing import broadcast_if_small

WORDS, PERCENT = 5, 75
PART_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
POSTINGS = 2_000_000  # prefix shingles of a bucket; a document is tied once in each bucket
KEY_BITS = 24  # of a shingle's hash inside its bucket, which holds some hundred thousand
CLASS_DOCS = 1_024  # documents of a block; classes up to two blocks are one cell
HEAPED = 2_000  # postings merged by a heap
TRIED = 24  # documents compared directly before a search
MU = 0.01  # weight of the long lists' length in DivideSkip's choice of how many to skip


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their n + 1 offsets. A text
    with fewer words has its whole sequence as one shingle, one without words none."""
    starts, ends, at = word_spans(data, off)
    hashes = span_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(hashes, words)
    count = np.diff(at)
    n = np.where(count >= words, count - words + 1, 0)
    values = grams[ranges(at[:-1], n)]
    doc = np.repeat(np.arange(len(count)), n)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        lone = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            seq = hashes[at[d] : at[d + 1]]
            lone[i] = gram_hashes(seq, len(seq))[0] ^ np.uint64(len(seq))
        values, doc = np.concatenate((values, mix(lone))), np.concatenate((doc, short))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(len(count) + 1))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Fewest shingles a set of n shares with any set it links with."""
    return -(-n * percent // 100)


def _parcels(texts: DataFrame, parts: int) -> DataFrame:
    """``part, ids, off, body``: texts of a batch by part of their ids, compressed."""

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = parts_of_ids(ids, parts)
            order = np.argsort(part, kind="stable")
            first, length = runs_of(part[order])
            for f, n in zip(first, length):
                pick = order[f : f + n]
                data, off = text_buffer(batch.column(1).take(pa.array(pick)))
                body = pa.compress(data.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[pick[0]]], pa.int32()), *(pa.array([v], pa.binary()) for v in (blob(ids[pick]), blob(off), body))],
                    ["part", "ids", "off", "body"],
                )

    return texts.mapInArrow(pack, "part int, ids binary, off binary, body binary")


def _opened(table: pa.Table):
    """Ids, text bytes and offsets of each parcel of a part."""
    for ids, off, body in zip(*(table.column(c).to_pylist() for c in ("ids", "off", "body"))):
        off = np.frombuffer(off, np.int64)
        data = pa.decompress(body, int(off[-1]), "zstd", asbytes=True) if off[-1] else b""
        yield np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8), off


def _keys(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and short hash of a shingle in one number."""
    short = values >> np.uint64(64 - KEY_BITS)
    return ((values % np.uint64(buckets)) << np.uint64(KEY_BITS)) | short


def _part_keys(table: pa.Table, words: int, buckets: int):
    """Sorted distinct keys of a part, each with its number of documents there."""
    found = [_keys(shingles(data, off, words)[0], buckets) for _, data, off in _opened(table)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def levels(parcels: DataFrame, words: int, buckets: int) -> DataFrame:
    """``part, bucket, level``: for the keys of each part, in order, the logarithm of
    the number of documents, 0 for a shingle of one document."""

    def send(table: pa.Table) -> pa.Table:
        keys, count = _part_keys(table, words, buckets)
        bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int32)
        short = (keys & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32)
        first, length = runs_of(bucket)
        part = table.column("part")[0].as_py()
        out: dict[str, list] = {"bucket": [], "keys": [], "n": []}
        for f, n in zip(first, length):
            mine = short[f : f + n]
            out["bucket"].append(int(bucket[f]))
            # bytes of one rank side by side: sorted keys repeat their high bytes
            out["keys"].append(b"".join(blob((mine >> s).astype(np.uint8)) for s in (16, 8, 0)))
            out["n"].append(blob(np.minimum(count[f : f + n], 65535).astype(np.uint16)))
        return pa.table({"part": pa.array([part] * len(first), pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
                         "keys": pa.array(out["keys"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        planes = [np.frombuffer(k, np.uint8).reshape(3, -1).astype(np.uint32) for k in table.column("keys").to_pylist()]
        keys = [(p[0] << 16) | (p[1] << 8) | p[2] for p in planes]
        total = np.zeros(1 << KEY_BITS, np.uint32)
        for k, n in zip(keys, table.column("n").to_pylist()):
            more = total[k] + np.frombuffer(n, np.uint16)  # keys of a part are distinct
            # counts stay at the largest number, which has the highest level, instead of starting afresh
            total[k] = np.where(more < total[k], np.uint32(0xFFFFFFFF), more)

        def level(k: np.ndarray) -> np.ndarray:
            return np.ceil(8 * np.log2(np.maximum(total[k], 1))).clip(0, 255).astype(np.uint8)

        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"),
                         "level": pa.array([blob(level(k)) for k in keys], pa.binary())})

    sent = parcels.groupBy("part").applyInArrow(send, "part int, bucket int, keys binary, n binary")
    return sent.groupBy("bucket").applyInArrow(meet, "part int, bucket int, level binary")


def described(parcels: DataFrame, found: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """``doc_id, n_shingles, same, prefix, set``: set size and digest; for documents
    that may link their shared prefix shingles and, once per set of a part, the set."""

    def describe(table: pa.Table, returned: pa.Table) -> pa.Table:
        keys, _ = _part_keys(table, words, buckets)
        level = joined(returned.sort_by("bucket").column("level"), np.uint8)
        ids_, n_, same_, prefix_, count_, set_ = [], [], [], [], [], []
        seen: dict[bytes, int] = {}
        for ids, data, off in _opened(table):
            values, at = shingles(data, off, words)
            mine = level[np.searchsorted(keys, _keys(values, buckets))]
            n = np.diff(at)
            shared = np.concatenate(([0], np.cumsum(mine > 0)))
            shared = shared[at[1:]] - shared[at[:-1]]
            for d in range(len(n)):
                s, own = values[at[d] : at[d + 1]], mine[at[d] : at[d + 1]]
                digest = blake2b(blob(s), digest_size=16).digest()
                need = least_overlap(int(n[d]), percent)
                kept, held = np.zeros(0, np.uint64), None
                if n[d] and shared[d] >= need:
                    order = np.lexsort((s, own))[: n[d] - need + 1]
                    kept, held = s[order[own[order] > 0]], len(set_)
                    # of equal sets of a part the smallest id carries the set
                    if digest in seen and ids_[seen[digest]] <= ids[d]:
                        held = None
                    elif digest in seen:
                        set_[seen[digest]] = None
                if held is not None:
                    seen[digest] = held
                ids_.append(int(ids[d]))
                n_.append(int(n[d]))
                same_.append(digest)
                prefix_.append(kept)
                count_.append(len(kept))
                set_.append(blob(s) if held is not None else None)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(count_))).astype(np.int32)),
            pa.array(np.concatenate(prefix_ or [np.zeros(0, np.uint64)]).view(np.int64)),
        )
        return pa.table({"doc_id": pa.array(ids_, pa.int64()), "n_shingles": pa.array(n_, pa.int64()),
                         "same": pa.array(same_, pa.binary()), "prefix": lists, "set": pa.array(set_, pa.binary())})

    return parcels.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
        describe, "doc_id long, n_shingles long, same binary, prefix array<long>, set binary"
    )


def _tie(h: np.ndarray, doc: np.ndarray):
    """Smallest document of each shingle, and the ties of the others to it."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first, length = runs_of(h)
    low = np.repeat(doc[first], length)
    other = doc != low
    ties = np.unique(np.stack([doc[other], low[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return h[first], doc[first], ties


def _forest(pairs: np.ndarray) -> np.ndarray:
    """The same components with one pair for each document but the smallest of each."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return np.stack([nodes[moved], nodes[label[moved]]], axis=1)
        label = new


def ties(prefixes: DataFrame, buckets: int) -> DataFrame:
    """``a, b``: documents tied by a prefix shingle, as stars around the smallest."""

    def send(batches):
        def flush(h, d):
            low_h, low_d, pairs = _tie(np.concatenate(h), np.concatenate(d))
            bucket = (low_h % np.uint64(buckets)).astype(np.int32)
            # 32 bits tell shingles of a bucket apart; a clash only ties documents that then fail to link
            low_h = (low_h >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            first, length = runs_of(bucket[order])
            for f, n in zip(first, length):
                pick = order[f : f + n]
                yield int(bucket[pick[0]]), blob(low_h[pick]), blob(low_d[pick]), None
            pairs = _forest(pairs)
            for b in range(0, len(pairs), 100_000):
                yield int(b // 100_000 % buckets), None, None, blob(pairs[b : b + 100_000])

        def rows(found):
            bucket, h, doc, pairs = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), *(pa.array(v, pa.binary()) for v in (h, doc, pairs))],
                ["bucket", "h", "doc", "pairs"],
            )

        h, d, held = [], [], 0
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            h.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            d.append(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n))
            held += len(h[-1])
            if held > 2_000_000:
                yield rows(flush(h, d))
                h, d, held = [], [], 0
        if held:
            yield rows(flush(h, d))

    def meet(table: pa.Table) -> pa.Table:
        _, _, found = _tie(joined(table.column("h"), np.uint32), joined(table.column("doc"), np.int64))
        known = joined(table.column("pairs"), np.int64).reshape(-1, 2)
        pairs = _forest(np.concatenate((found, known)))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sent = prefixes.mapInArrow(send, "bucket int, h binary, doc binary, pairs binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


class Lists:
    """Inverted lists over the sets of a cell, and exact searches in them."""

    def __init__(self, values: np.ndarray, at: np.ndarray, percent: int):
        self.values, self.at, self.percent = values, at, percent
        self.n = np.diff(at)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        order = np.argsort(values, kind="stable")  # documents rise inside a list
        self.docs = doc[order]
        first, self.length = runs_of(values[order])
        self.first = first
        term = np.empty(len(values), np.int64)
        term[order] = np.repeat(np.arange(len(first)), self.length)
        self.term = term
        self.longest = int(self.length.max()) if len(first) else 1

    def set_of(self, d: int) -> np.ndarray:
        return self.values[self.at[d] : self.at[d + 1]]

    def linked(self, a: int, b: int) -> bool:
        x, y = self.set_of(a), self.set_of(b)
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        if len(x) > len(y):
            x, y = y, x
        spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[spot] == x).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def search(self, d: int, wanted: np.ndarray) -> list[int]:
        """Documents among ``wanted`` (a mask) that link with d: DivideSkip."""
        need = least_overlap(int(self.n[d]), self.percent)
        terms = self.term[self.at[d] : self.at[d + 1]]
        terms = terms[self.length[terms] > 1]
        if len(terms) < need:
            return []
        terms = terms[np.argsort(self.length[terms], kind="stable")]
        long_ = min(need - 1, len(terms), int(need / (MU * np.log2(self.longest + 1) + 1)))
        split = len(terms) - long_
        # documents that are not wanted, such as those of the same class, leave the short lists first
        size = self.length[terms[:split]]
        docs = self.docs[ranges(self.first[terms[:split]], size)]
        keep = wanted[docs]
        docs, home = docs[keep], np.repeat(np.arange(split), size)[keep]
        x, seen = self._merged(docs, home)
        more = (seen >= need - long_) & (x != d)
        x, seen = x[more], seen[more]
        for left, t in zip(range(long_, 0, -1), terms[split:]):
            alive = seen + left >= need
            x, seen = x[alive], seen[alive]
            if not len(x):
                return []
            one = self.docs[self.first[t] : self.first[t] + self.length[t]]
            spot = np.minimum(np.searchsorted(one, x), len(one) - 1)
            seen = seen + (one[spot] == x)
        both = self.n[d] + self.n[x]
        return x[(seen >= need) & (100 * seen >= self.percent * (both - seen))].tolist()

    @staticmethod
    def _merged(docs: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the short lists and in how many each stands: a heap merges few
        postings, many are counted in one pass."""
        if len(docs) > HEAPED:
            count = np.bincount(docs)
            found = np.flatnonzero(count)
            return found, count[found]
        lists = np.split(docs, np.flatnonzero(home[1:] != home[:-1]) + 1) if len(docs) else []
        merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64, len(docs))
        first, length = runs_of(merged)
        return merged[first], length


def classes(values: np.ndarray, at: np.ndarray, percent: int = PERCENT, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set of a cell the first set its links connect it with. With ``sides``
    (0 or 1) only links between the sides are looked for."""
    n = len(at) - 1
    held = Lists(values, at, percent)
    label = np.arange(n)

    def unite(x: int, y: int) -> None:
        a, b = sorted((int(label[x]), int(label[y])))
        if a != b:
            label[label == b] = a

    for d in range(n):
        # a few documents in front are tried first: a copy mostly links with some of them,
        # and what its class already holds need not be searched
        heads = np.unique(label[:d])[:TRIED]
        for x in [*heads.tolist(), *np.unique(np.linspace(0, d - 1, TRIED, dtype=int)).tolist()] if d else []:
            if label[x] != label[d] and held.linked(x, d):
                unite(x, d)
        wanted = np.zeros(n, bool)
        wanted[:d] = label[:d] != label[d]
        if sides is not None:
            wanted &= sides != sides[d]
        if wanted.any():
            for x in held.search(d, wanted):
                unite(x, d)
    return label


def link_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: the smallest id
    reachable by links. Null and empty texts link with nothing; a row without an id
    has no component; rows of one id are one document in the links."""
    texts = texts_of(docs)
    size = total_bytes(texts)
    buckets = parts_for(size, BUCKET_BYTES)
    parcels = _parcels(texts.where("doc_id IS NOT NULL"), parts_for(size, PART_BYTES))
    known = written(described(parcels, levels(parcels, words, buckets), words, percent, buckets), "jaccard-sets")
    usable = known.where("n_shingles > 0")
    # equal sets: the smallest id stands for all; counted before, so copies are one row per task
    same = written(usable.groupBy("same").agg(F.min("doc_id").alias("rep")), "jaccard-same")
    postings = usable.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    tied = components(ties(usable.select("doc_id", "prefix"), parts_for(postings, POSTINGS)))
    # only the one that stands for equal sets goes on
    candidates = written(
        tied.join(same.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"), "jaccard-candidates"
    )
    links = _links(known.where("set IS NOT NULL").select("doc_id", "set"), candidates, size, percent)
    linked = components(links.unionByName(_repeated_ids(usable, same)))
    found = known.select("doc_id", "n_shingles", "same").join(same.select("same", "rep"), "same", "left")
    found = found.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id").alias("component_id"),
    )
    return found.unionByName(_without_id(texts, words))


def _without_id(texts: DataFrame, words: int) -> DataFrame:
    def count(batches):
        for batch in batches:
            _, at = shingles(*text_buffer(batch.column(1)), words)
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.nulls(n, pa.int64())],
                ["doc_id", "n_shingles", "component_id"],
            )

    return texts.where("doc_id IS NULL").mapInArrow(count, "doc_id long, n_shingles long, component_id long")


def _repeated_ids(usable: DataFrame, same: DataFrame) -> DataFrame:
    """Links between the classes of rows that share one id."""
    several = usable.groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y"), F.count("*").alias("n"))
    several = several.where("n > 1 AND x <> y").select("doc_id")
    rows = usable.join(several, "doc_id").join(same.select("same", "rep"), "same")
    return rows.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def _links(sets: DataFrame, candidates: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: links that connect what links connect, from the cells of the classes."""
    members = candidates.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    spot = candidates.join(members, "component").select(
        F.col("node").alias("doc_id"), "component",
        F.ceil(F.col("members") / CLASS_DOCS).cast("int").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # every pair of blocks is one cell; a document goes to the cells of its block
    lone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    cells = F.when(F.col("blocks") <= 2, lone).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    ))
    buckets = parts_for(size, BUCKET_BYTES)
    rows = sets.join(broadcast_if_small(written(spot.withColumn("cells", cells), "jaccard-cells")), "doc_id")
    placed = rows.select("doc_id", "component", "block", "blocks", F.explode("cells").alias("c"), "set").select(
        "doc_id", "component", "block", "blocks", "c.i", "c.j", "set"
    ).withColumn("bucket", F.pmod(F.xxhash64("component", "i", "j"), F.lit(buckets)).cast("int"))

    def link(table: pa.Table) -> pa.Table:
        ids, comp, block, i, j = (table.column(c).to_numpy() for c in ("doc_id", "component", "block", "i", "j"))
        held = table.column("set").to_pylist()
        order = np.lexsort((ids, j, i, comp))
        key = np.stack([comp[order], i[order], j[order]], axis=1)
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        cuts = [*np.flatnonzero(new), len(order)]
        out_a, out_b = [], []
        for f, e in zip(cuts[:-1], cuts[1:]):
            pick = order[f:e]
            pick = pick[np.concatenate(([True], ids[pick][1:] != ids[pick][:-1]))]
            if len(pick) < 2:
                continue
            sizes = np.array([len(held[k]) // 8 for k in pick])
            values = np.frombuffer(b"".join(held[k] for k in pick), np.uint64)
            across = i[pick[0]] != j[pick[0]]
            root = classes(values, np.concatenate(([0], np.cumsum(sizes))), percent, block[pick] if across else None)
            moved = np.flatnonzero(root != np.arange(len(root)))
            out_a.append(ids[pick[moved]])
            out_b.append(ids[pick[root[moved]]])
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.table({"a": cat[0], "b": cat[1]})

    return placed.groupBy("bucket").applyInArrow(link, "a long, b long")
