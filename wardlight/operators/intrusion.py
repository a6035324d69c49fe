"""Attack-or-normal classifiers on connection records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.boosting import DEPTH, MOST_VALUES, BoostedModel, fit_trees
from wardlight.operators.fp_model import SEED, LinearModel, binary_metrics, scored_by
from wardlight.plans.session import materialise, stored
from wardlight.sources.kdd import CATEGORIES, NUMBERS

MODELS = {"logistic": "LogisticRegression", "boosting": "GBTClassifier"}
WIDEST = 1_000  # weights whose products of two fit a task many times over
START_ROWS, START_SHARE = 1_000_000, 64  # from so many rows on, one in so many gives the weights to start from
STEPS, SETTLED = 100, 1e-9
UNEVEN = 1.25  # a task's rows to those of an even share
LEAST_ROWS, TASK_ROWS = 100_000, 1_000_000  # a task with fewer is soon done; most in a task of dealt rows
BAD_NUMBER = "a record has a number that is null or not a number"


def fit_kdd(train: DataFrame, model: str = "logistic", trees: int = 200) -> PipelineModel | LinearModel | BoostedModel:
    """Logistic regression on standardised numbers, or boosted trees on plain
    ones; categories are one-hot and unseen ones become zeros."""
    if model == "logistic":
        return fit_logistic(train)
    if model != "boosting":
        raise ValueError(f"unknown model {model}")
    return fit_boosting(train, trees)


INDEXED, HOT = [f"_{c}_i" for c in CATEGORIES], [f"_{c}_v" for c in CATEGORIES]


def _one_hot() -> list:
    return [
        StringIndexer(
            inputCols=CATEGORIES, outputCols=INDEXED, handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=INDEXED, outputCols=HOT, handleInvalid="keep"),
    ]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in tasks of like size. Files of few row groups are read by as few tasks, and every
    level of every tree would wait for them; only such rows are dealt out, and written once. (Spark's trees
    draw their thresholds from a sample that depends on where rows lie: small tables are left alone.)"""
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, sum(sizes)
    if max(sizes, default=0) <= max(UNEVEN * n / cores, LEAST_ROWS):
        return rows
    return materialise(rows.repartition(max(cores, n // TASK_ROWS)))


# ---- boosted trees


def fit_boosting(train: DataFrame, trees: int) -> PipelineModel | BoostedModel:
    """Boosted trees of depth 5. Categories of very many values are left to Spark's trees."""
    rows = dealt(train.select(*NUMBERS, *CATEGORIES, "attack"))
    seen = rows.agg(F.count("*").alias("n"), *(F.sort_array(F.collect_set(c)).alias(c) for c in CATEGORIES)).first()
    n, labels = seen["n"], [seen[c] for c in CATEGORIES]
    if not n:
        raise ValueError("no records")
    if max(len(v) for v in labels) > MOST_VALUES:
        stages = [
            VectorAssembler(inputCols=[*NUMBERS, *HOT], outputCol="features"),
            GBTClassifier(labelCol="attack", maxIter=trees, maxDepth=DEPTH, seed=SEED),
        ]
        return Pipeline(stages=[*_one_hot(), *stages]).fit(rows)
    return fit_trees(rows, n, NUMBERS, dict(zip(CATEGORIES, labels)), "attack", trees)


# ---- logistic regression


def fit_logistic(train: DataFrame) -> PipelineModel | LinearModel:
    """The optimum of the logistic loss with unit L2 penalty, by Newton's steps: each reads the rows once
    and adds up slopes and curvatures, so that nothing but the few weights is held. A sample's optimum is where the
    steps over all rows begin."""
    rows = train.select(*NUMBERS, *CATEGORIES, "attack")
    n, yes, mean, scale, labels = _profile(rows)
    if not n:
        raise ValueError("no records")
    if 1 + len(NUMBERS) + sum(len(v) + 1 for v in labels) > WIDEST:
        return _fit_wide(train, n)
    design = _design(mean, scale, labels)
    weights = np.zeros(1 + len(NUMBERS) + sum(len(v) + 1 for v in labels))
    if yes in (0, n):  # one class: no finite intercept is best
        weights[0] = np.inf if yes else -np.inf
    else:
        if n >= START_ROWS:
            some = materialise(rows.sample(1 / START_SHARE, seed=SEED))
            weights = _optimum(some, design, weights)
        weights = _optimum(rows, design, weights)
    plain = weights[1 : 1 + len(NUMBERS)] * scale
    out, rest = [("intercept", None, float(weights[0] - plain @ mean))], iter(weights[1 + len(NUMBERS) :].tolist())
    out += [(c, None, float(w)) for c, w in zip(NUMBERS, plain)]
    out += [(c, value, next(rest)) for c, values in zip(CATEGORIES, labels) for value in [*values, None]]
    return LinearModel(out)


def _profile(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]:
    """Rows, attacks, means and inverse deviations (0: constant) of the numbers, values of each category."""
    k = len(NUMBERS)

    def merged(parts):
        """Counts, means and squares around them of stretches of rows."""
        n, mean, square = 0, np.zeros(k), np.zeros(k)
        for more, m, s in parts:
            if more:
                gap = m - mean
                square = square + s + gap**2 * (n * more / (n + more))
                n, mean = n + more, mean + gap * (more / (n + more))
        return n, mean, square

    def each(batches):
        yes, values, stretches = 0, [set() for _ in CATEGORIES], []
        for batch in batches:
            if any(batch.column(i).null_count for i in (*range(k), k + len(CATEGORIES))):
                raise ValueError(BAD_NUMBER)
            x = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            if np.isnan(x).any():
                raise ValueError(BAD_NUMBER)
            mean = x.mean(axis=1)
            stretches = [merged([*stretches, (x.shape[1], mean, ((x - mean[:, None]) ** 2).sum(axis=1))])]
            yes += int(pc.sum(batch.column(k + len(CATEGORIES))).as_py() or 0)
            for i, found in enumerate(values, k):
                found.update(pc.unique(batch.column(i)).to_pylist())
        n, mean, square = merged(stretches)
        yield pa.RecordBatch.from_pylist([{
            "n": n, "yes": yes, "mean": mean.tolist(), "square": square.tolist(),
            "labels": [sorted(v - {None}) for v in values],
        }], schema)

    schema = pa.schema({"n": pa.int64(), "yes": pa.int64(), "mean": pa.list_(pa.float64()), "square": pa.list_(pa.float64()), "labels": pa.list_(pa.list_(pa.string()))})
    got = rows.mapInArrow(each, "n long, yes long, mean array<double>, square array<double>, labels array<array<string>>").collect()
    n, mean, square = merged([(r["n"], np.array(r["mean"]), np.array(r["square"])) for r in got])
    scale = np.array([1 / s if s else 0.0 for s in np.sqrt(square / max(n - 1, 1))])
    labels = [sorted(set().union(*(r["labels"][i] for r in got))) for i in range(len(CATEGORIES))]
    return n, sum(r["yes"] for r in got), mean, scale, labels


def _fit_wide(train: DataFrame, n: int) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=NUMBERS, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_scaled", *HOT], outputCol="features"),
        LogisticRegression(maxIter=1000, regParam=1.0 / n, standardization=False, labelCol="attack"),
    ]
    return Pipeline(stages=[*_one_hot(), *stages]).fit(train)


def _design(mean: np.ndarray, scale: np.ndarray, labels: list[list[str]]):
    """Features (one, scaled numbers, one-hot categories) and labels of a batch of records."""

    def made(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at, many = 1 + len(mean), batch.num_rows
        x = np.zeros((many, at + sum(len(v) + 1 for v in labels)))
        x[:, 0] = 1
        for i in range(len(mean)):
            np.subtract(batch.column(i).to_numpy(zero_copy_only=False), mean[i], out=x[:, 1 + i])
        x[:, 1:at] *= scale
        for i, values in enumerate(labels, len(mean)):
            found = pc.index_in(batch.column(i), value_set=pa.array(values, pa.string())).fill_null(len(values))
            x[np.arange(many), at + found.to_numpy(zero_copy_only=False)] = 1
            at += len(values) + 1
        return x, batch.column(len(mean) + len(labels)).to_numpy(zero_copy_only=False).astype(float)

    return made


def _optimum(rows: DataFrame, design, weights: np.ndarray) -> np.ndarray:
    d = len(weights)
    ridge = np.append(0.0, np.ones(d - 1))

    def sums(weights):
        def each(batches):
            total = np.zeros((d + 1, d))  # curvatures, and slopes as the last row
            loss = 0.0
            for batch in batches:
                x, y = design(batch)
                margin = x @ weights
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss += float((np.logaddexp(0, margin) - y * margin).sum())
                total[:d] += x.T @ (x * (p * (1 - p))[:, None])
                total[d] += x.T @ (p - y)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["loss", "sums"])

        loss, total = 0.0, np.zeros((d + 1, d))
        for r in rows.mapInArrow(each, "loss double, sums binary").collect():  # a few weights squared a task
            loss, total = loss + r["loss"], total + np.frombuffer(r["sums"]).reshape(d + 1, d)
        return loss + ridge @ weights**2 / 2, total[d] + ridge * weights, total[:d] + np.diag(ridge)

    before, best, move = weights, np.inf, np.zeros(d)
    for _ in range(STEPS):
        loss, slope, curve = sums(weights)
        if not loss <= best:  # too far: half the way
            move = move / 2
            weights = before - move
            continue
        before, best, move = weights, loss, np.linalg.lstsq(curve, slope, rcond=1e-15)[0]
        weights = weights - move
        if slope @ move <= SETTLED * loss:
            return weights
    raise RuntimeError(f"no optimum in {STEPS} steps")


# ---- evaluation


def evaluate_kdd(fitted: PipelineModel | LinearModel | BoostedModel, train: DataFrame, test: DataFrame, model: str) -> DataFrame:
    pred = fitted.transform(test) if isinstance(fitted, BoostedModel) else scored_by(fitted, test)
    if isinstance(fitted, LinearModel):
        fine = F.col("p").isNotNull() & ~F.isnan("p")
        pred = pred.withColumn("p", F.when(fine, F.col("p")).otherwise(F.raise_error(F.lit(BAD_NUMBER))))
        pred = pred.withColumn("prediction", (F.col("p") > 0.5).cast("double"))
    return measured_kdd(pred, train, model)


def measured_kdd(pred: DataFrame, train: DataFrame, model: str) -> DataFrame:
    """The report row of test rows with ``attack``, ``prediction`` and the score ``p``."""
    # read by each figure: the rows are scored once
    pred = stored(pred.select(F.col("attack").alias("label"), "prediction", "p"))
    seen = train.agg(F.count("*").alias("n"), F.avg("attack").alias("share")).first()
    return binary_metrics(pred).select(
        F.lit(MODELS[model]).alias("model"),
        F.lit(seen["n"]).cast("long").alias("n_train"),
        F.col("n").alias("n_test"),
        F.lit(round(100 * seen["share"], 1)).alias("train_attack_pct"),
        F.col("prevalence").alias("test_attack_pct"),
        "baseline", "accuracy", "precision", "recall", "f1", "auc",
    )
