"""Boosted regression trees on a table of any size.

The trees are those of Spark's GBTClassifier: logistic loss, variance gain, at most 32 bins of a number with
thresholds from a sample of 10,000 rows, one indicator a category's value. Rows are turned once into
small codes, two features in each number, and lie in blocks beside their scores so far. A level of a tree reads the
blocks once and brings one histogram of gradients a task; of two siblings the larger one's is what the smaller
one's leaves of the parent's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame

from wardlight.operators.fp_model import SEED
from wardlight.plans.session import remove, shared_dir

DEPTH, BINS, RATE = 5, 32, 0.1
SAMPLE = 10_000  # rows that thresholds are drawn from, all of a smaller table
MOST_VALUES = 254  # of a category, besides those the fit did not see
WIDE = 4096  # most codes of two features in one number
BLOCK_ROWS = 1 << 17
KEEP = 10  # trees after which scores are written, so that the way to them stays short
COLLECTED = 64  # tasks whose histograms go straight to the driver
NO_GAIN = 1e-12  # of a node's squares: rounding
BAD_NUMBER = "a record has a number that is null or not a number"


@dataclass
class Tree:
    """A full tree: a row goes left if its code of the node's feature lies between both ends."""

    feature: np.ndarray  # of the inner nodes, level by level
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray  # of the leaves


@dataclass
class Coding:
    """Numbers as bins, categories as places among their values; last come values not seen, and null."""

    numbers: list[str]
    thresholds: list[np.ndarray]
    categories: dict[str, list[str]]

    @property
    def widths(self) -> list[int]:
        return [len(t) + 1 for t in self.thresholds] + [len(v) + 1 for v in self.categories.values()]

    @property
    def pairs(self) -> list[tuple[int, ...]]:
        """Features that share a number."""
        out, widths = [], self.widths
        for f, width in enumerate(widths):
            if out and len(out[-1]) == 1 and widths[out[-1][0]] * width <= WIDE:
                out[-1] += (f,)
            else:
                out.append((f,))
        return out

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row per pair."""
        out = np.empty((len(self.widths), batch.num_rows), np.uint8)
        for i, (name, cuts) in enumerate(zip(self.numbers, self.thresholds)):
            column = batch.column(name)
            x = column.to_numpy(zero_copy_only=False)
            if column.null_count or np.isnan(x).any():
                raise ValueError(BAD_NUMBER)
            out[i] = np.searchsorted(cuts, x, "left")
        for i, (name, values) in enumerate(self.categories.items(), len(self.numbers)):
            out[i] = pc.index_in(batch.column(name), value_set=pa.array(values, pa.string())).fill_null(len(values))
        widths = self.widths
        return np.array([
            out[p[0]] if len(p) == 1 else out[p[0]].astype(np.uint16) * widths[p[1]] + out[p[1]] for p in self.pairs
        ], np.uint16)


def thresholds_of(values: np.ndarray, expected: float, n: int) -> np.ndarray:
    """At most ``BINS`` - 1 midpoints between neighbouring values of a sample, as Spark places them in a table of ``n``
    rows: what the sample's other values lack to the ``expected`` number of rows are zeros."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    if expected - counts.sum() > 1e-9:
        at = int(np.searchsorted(found, 0))
        found, counts = np.insert(found, at, 0), np.insert(counts, at, expected - counts.sum())
    middle, most = (found[:-1] + found[1:]) / 2, min(BINS, n) - 1
    if len(middle) <= most:
        return middle
    upto, stride = np.cumsum(counts), expected / (most + 1)
    target, cuts = stride, []
    for i, (before, now) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
        if abs(before - target) < abs(now - target):
            cuts.append(middle[i])
            target += stride
    return np.array(cuts)


def sampled(rows: DataFrame, share: float) -> pa.Table:
    """The rows that Spark's trees would draw their thresholds from."""
    spark = rows.sparkSession
    if share >= 1:
        return rows.toArrow()
    seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(SEED).nextInt()
    drawn = rows._jdf.javaRDD().sample(False, share, seed)
    return DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark).toArrow()


# ---- one block of rows


def rows_of_nodes(codes: np.ndarray, column: np.ndarray, left: np.ndarray, levels: int) -> list[np.ndarray]:
    """Rows of each node of a level."""
    groups: list[np.ndarray | None] = [None]  # all rows
    for level in range(levels):
        parted = []
        for node, some in enumerate(groups, (1 << level) - 1):
            code = codes[column[node]]
            goes = left[node].take(code if some is None else code.take(some))
            parted += [np.flatnonzero(goes), np.flatnonzero(~goes)] if some is None else [some[goes], some[~goes]]
        groups = parted
    return groups


def _ways(tree: Tree, coding: Coding) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node: the number that holds its feature, and for all of that number's codes whether they go left."""
    widths, pairs = coding.widths, coding.pairs
    where = {f: (p, i) for p, pair in enumerate(pairs) for i, f in enumerate(pair)}
    size = max(math.prod(widths[f] for f in pair) for pair in pairs)
    table, column = np.ones((len(tree.feature), size), bool), np.zeros(len(tree.feature), np.int64)
    for node, f in enumerate(tree.feature.tolist()):
        column[node], i = where[f]
        pair = pairs[column[node]]
        code = np.arange(size)
        if len(pair) == 2:
            code = code % widths[pair[1]] if i else code // widths[pair[1]]
        table[node] = (code >= tree.low[node]) & (code <= tree.high[node])
    return column, table


def histogram(codes: np.ndarray, coding: Coding, groups: list[np.ndarray] | None, gradient: np.ndarray) -> np.ndarray:
    """Rows and gradients by group of rows (None: one of all), feature and bin."""
    widths, out, many = coding.widths, [], 1
    if groups is not None:
        some, many = np.concatenate(groups), len(groups)
        slot = np.repeat(np.arange(many), [len(g) for g in groups])
        gradient = gradient.take(some)
    for pair, code in zip(coding.pairs, codes):
        size = math.prod(widths[f] for f in pair)
        at = code.astype(np.int64) if groups is None else slot * size + code.take(some)
        both = np.array([np.bincount(at, minlength=many * size), np.bincount(at, gradient, many * size)])
        both = both.reshape(2, many, *(widths[f] for f in pair))
        out += [both] if len(pair) == 1 else [both.sum(axis=3), both.sum(axis=2)]
    return np.concatenate(out, axis=2)


def gradients(label: np.ndarray, score: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the labels themselves (1 or -1) for the first one."""
    if score is None:
        return label
    return 4 * label / (1 + np.exp(np.clip(2 * label * score, -700, 700)))


def add_tree(score: np.ndarray, tree: Tree, codes: np.ndarray, ways: tuple[np.ndarray, np.ndarray], rate: float) -> None:
    for some, value in zip(rows_of_nodes(codes, *ways, DEPTH), tree.value.tolist()):
        score[some] += rate * value


# ---- growing


def best_splits(found: np.ndarray, coding: Coding) -> list[tuple[float, int, int, int, np.ndarray] | None]:
    """For each node of a histogram: gain, feature, lowest and highest code that go left, and rows and
    gradients of these. None: no split gains anything. The first of equal ones counts."""
    widths, best = coding.widths, []
    starts = np.concatenate(([0], np.cumsum(widths)))
    numbers = len(coding.numbers)
    left = np.empty_like(found)
    real = np.ones(found.shape[2], bool)
    for f in range(len(widths)):
        part = slice(starts[f], starts[f + 1])
        left[:, :, part] = found[:, :, part].cumsum(axis=2) if f < numbers else found[:, :, part]
        if f < numbers:
            real[starts[f + 1] - 1] = False  # all rows
    total = found[:, :, starts[0] : starts[1]].sum(axis=2)
    n, s = total[0][:, None], total[1][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + (s - left[1]) ** 2 / (n - left[0]) - s**2 / n
    gain = np.where(real & (left[0] > 0) & (left[0] < n), gain, -np.inf)
    for k, at in enumerate(gain.argmax(axis=1).tolist()):
        if not gain[k, at] > NO_GAIN * max(s[k, 0] ** 2 / max(n[k, 0], 1), 1e-300):
            best.append(None)
            continue
        f = int(np.searchsorted(starts, at, "right")) - 1
        code = at - int(starts[f])
        best.append((float(gain[k, at]), f, 0 if f < numbers else code, code, left[:, k, at]))
    return best


def _summed(histograms, shape) -> np.ndarray:
    """Sum over tasks; of very many tasks in two steps."""
    add = lambda a, b: a + b
    if histograms.getNumPartitions() > COLLECTED:
        return histograms.treeReduce(add)
    total = np.zeros(shape)
    for h in histograms.collect():
        total = total + h
    return total


def fit_trees(rows: DataFrame, n: int, numbers: list[str], categories: dict[str, list[str]], label: str, trees: int) -> BoostedModel:
    """Boosted trees for ``label`` (0 or 1) in a table of ``n`` rows."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / n)
    drawn = sampled(rows.select(*numbers), share)
    coding = Coding(list(numbers), [thresholds_of(drawn.column(c).to_numpy(), share * n, n) for c in numbers], categories)
    widths, pairs = coding.widths, coding.pairs

    def block(batches):
        held, size = [], 0

        def made():
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if batch.column(label).null_count:
                raise ValueError(BAD_NUMBER)
            yes = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int8) * 2 - 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes()], pa.binary()) for v in (coding.codes(batch), yes)], ["codes", "label"]
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    one = BatchedSerializer(CPickleSerializer(), 1)  # blocks and scores are zipped one by one
    blocks = rows.mapInArrow(block, "codes binary, label binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1])))
    blocks = blocks._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    shape, grown, scores, old = (2, 1, sum(widths)), [], None, []

    def opened(element):
        codes, label = element
        label = np.frombuffer(label, np.int8).astype(float)
        return np.frombuffer(codes, np.uint16).reshape(len(pairs), -1), label

    def scored(last, rate):
        """Scores of all rows once a tree is added, and the histogram of the next tree's root."""

        def add(elements):
            ways = _ways(last, coding) if last else None
            for element in elements:
                codes, label = opened(element[0] if last else element)
                score = None
                if last:
                    score = np.frombuffer(element[1][0]).copy() if element[1][0] else np.zeros(len(label))
                    add_tree(score, last, codes, ways, rate)
                yield b"" if score is None else score.tobytes(), histogram(codes, coding, None, gradients(label, score))

        return add

    def level_histogram(tree, chosen, levels):
        def each(elements):
            total, ways = np.zeros((2, len(chosen), sum(widths))), _ways(tree, coding)
            for element, (score, _) in elements:
                codes, label = opened(element)
                groups = rows_of_nodes(codes, *ways, levels)
                total += histogram(codes, coding, [groups[k] for k in chosen], gradients(label, np.frombuffer(score) if score else None))
            yield total

        return each

    def sums_of_roots(elements):
        total = np.zeros(shape)
        for _, h in elements:
            total += h
        yield total

    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    try:
        for turn in range(trees):
            last = grown[-1] if grown else None
            source = blocks.zip(scores) if last else blocks
            now = source.mapPartitions(scored(last, RATE if turn > 1 else 1.0))._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if turn and turn % KEEP == 0:
                now.checkpoint()
            root = _summed(now.mapPartitions(sums_of_roots), shape)
            if scores is not None:
                scores.unpersist()
            if turn and turn % KEEP == 0 and (kept := now.getCheckpointFile()):
                for gone in old:
                    remove(spark, gone)
                old = [kept]
            scores = now
            both = blocks.zip(scores)
            grown.append(_grown(root, coding, lambda tree, chosen, levels: _summed(
                both.mapPartitions(level_histogram(tree, chosen, levels)), (2, len(chosen), sum(widths)))))
    finally:
        blocks.unpersist()
        if scores is not None:
            scores.unpersist()
        for gone in old:
            remove(spark, gone)
    return BoostedModel(coding, grown)


def _grown(root: np.ndarray, coding: Coding, ask) -> Tree:
    """A tree from the histogram of its root; ``ask`` brings those of some nodes of a level."""
    inner = (1 << DEPTH) - 1
    tree = Tree(np.zeros(inner, np.int64), np.zeros(inner, np.int64), np.full(inner, 1 << 30), np.zeros(1 << DEPTH))
    first = coding.widths[0]
    nodes = {0: root}  # histograms of the level's nodes that may be split
    for level in range(DEPTH):
        places = sorted(nodes)
        splits = best_splits(np.concatenate([nodes[k] for k in places], axis=1), coding) if places else []
        parents, small, sums = {}, [], {}
        for k, split in zip(places, splits):
            total = nodes[k][:, 0, :first].sum(axis=1)
            if split is None:
                _leaf(tree, level, k, total)
                continue
            node = (1 << level) - 1 + k
            _, tree.feature[node], tree.low[node], tree.high[node], left = split
            sums[2 * k], sums[2 * k + 1] = left, total - left
            parents[k] = nodes[k]
            small.append(2 * k + int(sums[2 * k + 1][0] < left[0]))
        if level == DEPTH - 1 or not parents:
            for k, total in sums.items():
                _leaf(tree, level + 1, k, total)
            break
        found = ask(tree, small, level + 1)
        nodes = {}
        for i, k in enumerate(small):
            mine = found[:, i : i + 1]
            other = parents[k // 2] - mine
            other[1][other[0] == 0] = 0  # rounding
            nodes[k], nodes[k ^ 1] = mine, other
    return tree


def _leaf(tree: Tree, level: int, k: int, total: np.ndarray) -> None:
    """A node that is not split: its rows go left down to the leaves."""
    tree.value[k << (DEPTH - level)] = total[1] / total[0]


@dataclass
class BoostedModel:
    coding: Coding
    trees: list[Tree]

    def transform(self, df: DataFrame) -> DataFrame:
        """``attack``, ``p`` and ``prediction`` of each row."""
        coding, trees = self.coding, self.trees
        names = [*coding.numbers, *coding.categories]

        def score(batches):
            ways = [_ways(tree, coding) for tree in trees]
            for batch in batches:
                codes, total = coding.codes(batch), np.zeros(batch.num_rows)
                for i, (tree, way) in enumerate(zip(trees, ways)):
                    add_tree(total, tree, codes, way, RATE if i else 1.0)
                p = 1 / (1 + np.exp(np.clip(-2 * total, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("attack").cast(pa.int32()), pa.array(p), pa.array((total > 0).astype(float))], ["attack", "p", "prediction"]
                )

        return df.select(*names, "attack").mapInArrow(score, "attack int, p double, prediction double")
