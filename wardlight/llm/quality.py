"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on the statistics of a bounded sample of labelled documents give
paths; each path is a conjunctive rule; a logistic model with an L1 penalty keeps
few of them; the kept rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import WHITE, slices, span_hashes, text_buffer, texts_of, word_spans, written

TRAIN_ROWS = 20_000  # most labelled rows a model is fitted on, chosen by hashed id
TREES, DEPTH, BINS = 40, 3, 24
PENALTY = 0.002
ACCEPT = 0.3
STATS = [
    "length", "words", "word_length", "longest_word", "upper", "digit", "white", "breaks", "bang", "bar", "symbol",
    "stop", "comma", "other", "distinct", "same_as_previous", "top_word", "same_two_back",
]


def _class_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "upper": _class_table(bytes(range(65, 91))), "digit": _class_table(bytes(range(48, 58))), "white": WHITE,
    "breaks": _class_table(b"\n"), "bang": _class_table(b"!?"), "bar": _class_table(b"|"),
    "symbol": _class_table(b"#$%&*@^~=<>{}[]\\_+"), "stop": _class_table(b"."), "comma": _class_table(b",;:"),
    "other": _class_table(bytes(range(128, 256))),
}


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` per text; shares are per byte or per word, empty texts all 0."""
    n = len(off) - 1
    out = np.zeros((n, len(STATS)))
    size = np.diff(off)
    per_byte = np.maximum(size, 1)
    col = {name: k for k, name in enumerate(STATS)}
    out[:, col["length"]] = size
    for name, table in _CLASSES.items():
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        out[:, col[name]] = (sums[off[1:]] - sums[off[:-1]]) / per_byte
    starts, ends, at = word_spans(data, off)
    words = np.diff(at)
    per_word = np.maximum(words, 1)
    lengths = ends - starts
    sums = np.concatenate(([0], np.cumsum(lengths)))
    out[:, col["words"]] = words
    out[:, col["word_length"]] = (sums[at[1:]] - sums[at[:-1]]) / per_word
    hashes = span_hashes(data, starts, ends, lower=True)
    for back, name in ((1, "same_as_previous"), (2, "same_two_back")):
        same = np.zeros(len(hashes) + 1, np.int64)
        same[back + 1 :] = np.cumsum(hashes[back:] == hashes[:-back]) if len(hashes) > back else 0
        # pairs that reach into the text before do not count
        first = np.minimum(at[:-1] + back, at[1:])
        out[:, col[name]] = (same[at[1:]] - same[first]) / per_word
    for i in np.flatnonzero(words):
        a, b = at[i], at[i + 1]
        _, counts = np.unique(hashes[a:b], return_counts=True)
        out[i, col["distinct"]] = len(counts) / (b - a)
        out[i, col["top_word"]] = counts.max() / (b - a)
        out[i, col["longest_word"]] = lengths[a:b].max()
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text (null: empty)."""

    def measured(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, 4 << 20):
                found = measures(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(found[:, k]) for k in range(len(STATS)))],
                    ["doc_id", *STATS],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(measured, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def learnable() -> Column:
    """Rows whose labels a model may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold), all must hold


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        def holds(rule: Rule) -> Column:
            tests = [F.col(STATS[k]) <= t if low else F.col(STATS[k]) > t for k, low, t in rule]
            return reduce(lambda a, b: a & b, tests)

        terms = [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _matches(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([x[:, k] <= t if low else x[:, k] > t for k, low, t in rule])


def _grow(codes, edges, gain_of, rows, depth, path, out) -> None:
    """Best split by squared error of the residuals, down to ``depth``."""
    g = gain_of[rows]
    best = (1e-9, None)
    total, n = g.sum(), len(rows)
    for k in range(codes.shape[1]):
        size = len(edges[k]) + 1
        if size < 2:
            continue
        c = codes[rows, k]
        left_n = np.cumsum(np.bincount(c, minlength=size))[:-1]
        left_g = np.cumsum(np.bincount(c, g, minlength=size))[:-1]
        ok = (left_n >= 5) & (n - left_n >= 5)
        if not ok.any():
            continue
        gain = np.where(ok, left_g**2 / np.maximum(left_n, 1) + (total - left_g) ** 2 / np.maximum(n - left_n, 1), -1)
        gain -= total**2 / n
        b = int(gain.argmax())
        if gain[b] > best[0]:
            best = (gain[b], (k, b))
    if depth == 0 or best[1] is None:
        out.append((path, rows, g.mean() if n else 0.0))
        return
    k, b = best[1]
    low = codes[rows, k] <= b
    _grow(codes, edges, gain_of, rows[low], depth - 1, (*path, (k, True, float(edges[k][b]))), out)
    _grow(codes, edges, gain_of, rows[~low], depth - 1, (*path, (k, False, float(edges[k][b]))), out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Distinct paths, inner nodes included, of boosted trees on half-samples."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(11)
    margin, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        left: list = []
        pick = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        residual = y - 1 / (1 + np.exp(-margin))
        _grow(codes, edges, residual, pick, depth, (), left)
        for path, _, value in left:
            for end in range(1, len(path) + 1):
                found[path[:end]] = None
            if path:
                margin[_matches(x, path)] += 0.8 * 4 * value
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400):
    """Weights and bias by accelerated proximal steps; the bias is not penalised."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / n + 1)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Without both labels the model is the smoothed share of label 1."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        share = y.mean()
        return RuleModel([], [], float(np.log(share / (1 - share))))
    z = np.stack([_matches(x, r) for r in rules], axis=1).astype(float)
    w, b = lasso_logistic(z, y)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[k] for k in kept], [float(w[k]) for k in kept], b)


def _known(labels: DataFrame) -> DataFrame:
    """``doc_id, __y`` of the labels to learn from."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("__y"))
        .where(F.col("__y").isin(0.0, 1.0)).where(learnable())
    )


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """Fitted on at most ``rows`` labelled rows, taken by hashed id. Labels other
    than 0 and 1 are left out."""
    known = _known(labels)
    # sides in this order: the label table is the smaller one
    sample = (
        stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(rows)
        .select("__y", *STATS).toPandas()
    )
    return fit(sample[STATS].to_numpy(), sample["__y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. A row without an id
    is scored, never learned from and not held out."""
    stats = written(statistics(docs), "quality-statistics")
    model = train(stats, labels)
    score = model.score()
    return stats.select(
        "doc_id", (~F.coalesce(learnable(), F.lit(True))).alias("held_out"), score.alias("score"),
        F.when(score >= accept, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, unchanged. Statistics and score are
    made beside each row, so no text is shuffled; before that only the labelled rows that
    the model is fitted on are measured."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"))
    sample = ids.join(_known(labels), F.col("__id") == F.col("doc_id")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(TRAIN_ROWS)
    sample = F.broadcast(sample.select("__id").distinct())  # TRAIN_ROWS at most
    fitted_on = texts_of(docs).join(sample, F.col("doc_id") == F.col("__id"), "left_semi")
    score = train(written(statistics(fitted_on), "quality-statistics"), labels).score()
    at, names = docs.columns.index("text"), docs.columns
    row = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    schema = T.StructType([*row.fields, *(T.StructField(s, T.DoubleType()) for s in STATS)])

    def measured(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(at))
            found = [measures(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, 4 << 20)]
            values = np.concatenate(found) if found else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(values[:, k]) for k in range(len(STATS)))], schema.names
            )

    kept = docs.mapInArrow(measured, schema).where(score >= accept)
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
