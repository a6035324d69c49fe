"""SimHash near-duplicate classes through vantage-point trees over fingerprints.

A vantage point and a radius part fingerprints by their Hamming distance to the point. By
the triangle inequality a fingerprint within ``RADIUS`` bits of one on the other side has a
distance within ``RADIUS`` of the boundary, so only that band of one side (the smaller
band) also visits the other side. The top of the tree, fitted on a sample, deals all distinct
fingerprints into shards: each is at home in one shard and visits the shards whose
boundaries it overlaps. Inside a shard the same rule goes on down to small leaves, whose
members are compared exactly. No pair is lost, whatever the sample looks like; a sample
that fits badly only makes shards uneven.

A shard returns a spanning forest of its links, at most one edge a fingerprint it holds, and the
connected components of all edges are found with Spark joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import LOWER, parts_for, ranges, runs_of, slices, text_buffer, texts_of, word_spans, written
from wardlight.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2  # differing bits of a link
SHARD = 50_000  # fingerprints at home in a shard
SAMPLE_SHARE = 250  # one in so many fingerprints is in the sample the top tree is fitted on
SAMPLE_MOST = 4_000_000  # bound of the sample, 32 MB
SAMPLE_LEAF = 64  # least sample fingerprints of a shard
LEAF = 96  # fingerprints compared directly
CANDIDATES, PROBED = 8, 512  # vantage points tried for a split, fingerprints they are judged by
HELD_PAIRS = 1 << 20  # pairs held before they are reduced to a forest
BLOCK_SHINGLES = 1 << 18
HOT = 1_000_000  # rows of a fingerprint that one task takes in the last join
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text: bit k is set if more than half of the text's shingle
    hashes have it set; zero without words."""
    out = np.zeros(len(off) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j in slices(off, 4 << 20):
        base = off[i]
        part, cuts = data[base : off[j]], off[i : j + 1] - base
        starts, ends, at = word_spans(part, cuts)
        size = ends - starts
        place = np.cumsum(size + 1) - size - 1
        plain = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        plain[ranges(place, size)] = LOWER[part[ranges(starts, size)]]
        n = np.diff(at)
        shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        first = ranges(at[:-1], shingles)
        last = first + np.repeat(np.minimum(n, SHINGLE), shingles) - 1
        a, b = place[first], place[last] + size[last]
        raw, owner = plain.tobytes(), np.repeat(np.arange(j - i), shingles)
        counts = np.zeros((j - i, 64), np.int64)
        for s in range(0, len(a), BLOCK_SHINGLES):
            e = min(len(a), s + BLOCK_SHINGLES)
            spans = zip(a[s:e].tolist(), b[s:e].tolist())
            hashes = np.fromiter((digest(raw[x:y], SEED) for x, y in spans), np.uint64, e - s)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads, _ = runs_of(owner[s:e])
            counts[owner[s:e][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        out[i:j] = ((2 * counts > shingles[:, None]).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for each row of ``docs`` (a null text is an empty one)."""

    def apply(batches):
        for batch in batches:
            fp = fingerprints(*text_buffer(batch.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(apply, "doc_id long, fp long")


@dataclass
class Split:
    """A vantage point: up to ``radius`` bits away is inside. The band of the ``inner`` or
    outer side within ``RADIUS`` bits of the boundary visits the other side."""

    point: np.uint64
    radius: int
    inner: bool

    def sides(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks: at home inside, in the band of the side that visits."""
        d = np.bitwise_count(fps ^ self.point).astype(np.int16)
        low, high = (self.radius - RADIUS, self.radius) if self.inner else (self.radius, self.radius + RADIUS)
        return d <= self.radius, (d > low) & (d <= high)

    def children(self, own: np.ndarray, visiting: np.ndarray, fps: np.ndarray):
        """Places at home and visiting, inside and outside. A visitor goes wherever a link
        from its place may lead."""
        inside, band = self.sides(fps[own])
        d = np.bitwise_count(fps[visiting] ^ self.point).astype(np.int16)
        cross_in, cross_out = own[band & ~inside], own[band & inside]
        yield own[inside], np.concatenate([visiting[d <= self.radius + RADIUS], cross_in])
        yield own[~inside], np.concatenate([visiting[d > self.radius - RADIUS], cross_out])


def best_split(fps: np.ndarray) -> Split | None:
    """The split with the smallest larger side, visitors included, among a few vantage points
    spread over ``fps``; none if nothing parts them."""
    probed = fps[:: -(-len(fps) // PROBED)]
    best, least = None, len(probed)
    for point in fps[:: -(-len(fps) // CANDIDATES)]:
        counts = np.bincount(np.bitwise_count(probed ^ point), minlength=65)
        upto = np.concatenate(([0] * RADIUS, np.cumsum(counts), [len(probed)] * RADIUS))
        r = np.arange(65)
        inside = upto[r + RADIUS]
        band_in, band_out = inside - upto[r], upto[r + 2 * RADIUS] - inside
        for inner, cost in (
            (True, np.maximum(inside, len(probed) - inside + band_in)),
            (False, np.maximum(inside + band_out, len(probed) - inside)),
        ):
            cost = np.where((inside > 0) & (inside < len(probed)), cost, len(probed))
            at = int(np.argmin(cost))
            if cost[at] < least:
                best, least = Split(point, at, inner), int(cost[at])
    return best


@dataclass
class TopTree:
    """The splits that deal fingerprints into shards."""

    splits: list[Split] = field(default_factory=list)
    below: list[tuple[int, int]] = field(default_factory=list)  # children: a split, or -1 - shard
    shards: int = 0

    @classmethod
    def fitted(cls, sample: np.ndarray, leaf: int) -> TopTree:
        """Splits down to ``leaf`` fingerprints of the sample."""
        tree = cls()

        def grow(fps: np.ndarray) -> int:
            split = best_split(fps) if len(fps) > leaf else None
            if split is None:
                tree.shards += 1
                return -tree.shards
            at = len(tree.splits)
            tree.splits.append(split)
            tree.below.append((0, 0))
            inside, _ = split.sides(fps)
            tree.below[at] = grow(fps[inside]), grow(fps[~inside])
            return at

        grow(sample)
        return tree

    def dealt(self, fps: np.ndarray):
        """``shard, places at home, places visiting`` of the shards that ``fps`` reach."""
        none = np.zeros(0, np.int64)
        todo = [(0 if self.splits else -1, np.arange(len(fps)), none)]
        while todo:
            at, own, visiting = todo.pop()
            if not len(own) and not len(visiting):
                continue
            if at < 0:
                yield -1 - at, own, visiting
                continue
            todo += [(child, *part) for child, part in zip(self.below[at], self.splits[at].children(own, visiting, fps))]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same of ``n`` nodes as ``a - b`` do: each node but a
    component's least one to that."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _direct(own: np.ndarray, visiting: np.ndarray, fps: np.ndarray):
    """All links of the fingerprints at home, among them and with visitors, compared exactly."""
    other = np.concatenate([own, visiting])
    rows = max(1, (1 << 21) // max(1, len(other)))
    for i in range(0, len(own), rows):
        d = np.bitwise_count(fps[own[i : i + rows], None] ^ fps[None, other])
        x, y = np.nonzero(d <= RADIUS)
        x += i
        later = y > x  # each pair at home once; visitors follow them
        yield own[x[later]], other[y[later]]


def links_in(fps: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links of the first ``home`` fingerprints, all distinct, among them and with the others."""
    a, b, held = [], [], 0
    todo = [(np.arange(home), np.arange(home, len(fps)))]
    while todo:
        own, visiting = todo.pop()
        if not len(own):
            continue
        split = best_split(fps[own]) if len(own) > LEAF else None
        if split:
            parts = list(split.children(own, visiting, fps))
            work = sum(len(o) * (len(o) + len(v)) for o, v in parts)
            # close together, nothing parts them well: compare
            if work <= 0.95 * len(own) * (len(own) + len(visiting)):
                todo += parts
                continue
        for x, y in _direct(own, visiting, fps):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > HELD_PAIRS:
                x, y = forest(np.concatenate(a), np.concatenate(b), len(fps))
                a, b, held = [x], [y], len(x) // 2
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b), len(fps))


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (``fp``, long, unique) that connect all of
    them that links connect."""
    n = fps.count()
    share = max(SAMPLE_SHARE, -(-n // SAMPLE_MOST))
    leaf = max(SHARD, SAMPLE_LEAF * share)  # fingerprints at home in a shard
    sample = np.zeros(0, np.uint64)
    if n > leaf:
        some = fps.where(F.pmod(F.xxhash64(F.col("fp"), F.lit("sample")), F.lit(share)) == 0).select("fp")
        sample = np.sort(some.toArrow().column(0).to_numpy().astype(np.int64)).view(np.uint64)
    tree = TopTree.fitted(np.random.default_rng(SEED).permutation(sample), max(1, leaf // share))

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, home, visiting in tree.dealt(own):
                at = np.concatenate([home, visiting])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), shard, np.int32)),
                        pa.array(own[at].view(np.int64)),
                        pa.array(np.arange(len(at)) < len(home)),
                    ],
                    ["shard", "fp", "home"],
                )

    def join(group: pa.Table) -> pa.Table:
        held = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        held = np.concatenate([held[home], held[~home]])
        a, b = links_in(held, int(home.sum()))
        return pa.table({"a": held[a].view(np.int64), "b": held[b].view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(join, "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``: its SimHash over 3-word
    shingles (repeats counted) in 16 hexadecimal digits, and the smallest ``doc_id`` that links
    (two fingerprints with ``RADIUS`` differing bits at most) lead to.

    A null text is an empty one; texts without words have fingerprint zero and are linked with
    each other and their neighbours like any others. Each row has its own fingerprint, also
    rows of one id. Rows without an id link nothing and have no component. Other columns are left out.
    """
    rows = written(fingerprinted(docs), "simhash-rows")
    fps = written(
        rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")),
        "simhash-fingerprints",
    )
    edges = written(links(fps), "simhash-links")
    named = fps.select("fp", "n", F.col("least").alias("component_id"))
    if edges.limit(1).count():
        found = components(edges).withColumnRenamed("node", "fp").join(fps.select("fp", "least"), "fp")
        lowest = found.groupBy("component").agg(F.min("least").alias("low"))
        linked = found.join(lowest, "component").select("fp", "low")
        named = named.join(linked, "fp", "left").select("fp", "n", F.coalesce("low", "component_id").alias("component_id"))
    # a fingerprint of very many rows is dealt out over salts; there are rows / HOT such fingerprints at most
    salts = F.ceil(F.col("n") / HOT).cast("int")
    hot = F.broadcast(fps.where(F.col("n") > HOT).select("fp", salts.alias("salts")))
    spread = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")
    left = rows.join(hot, "fp", "left").select("doc_id", "fp", spread.alias("salt"))
    right = named.select("fp", "component_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return left.join(right, ["fp", "salt"], "left").select(
        "doc_id", shown, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
