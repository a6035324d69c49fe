"""False-positive model: features, split, fit, honest metrics, scoring and the
selection and summary of incidents asked about."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.functions.text import fold, strip
from wardlight.operators.relevance import containment_gold
from wardlight.plans.ordering import numbered, top_per_group
from wardlight.plans.session import materialise
from wardlight.plans.sizing import at_most, broadcast_if_small, small_values
from wardlight.plans.skew import salted_join

SEED = 42
# fixed values: severity order, level of unknown severities, class labels
SEVERITY_LEVEL = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
UNKNOWN_LEVEL = 1
FALSE_ALARM, REAL = "falso positivo", "incidente real"

CATEGORIES = ["kind", "technique", "environment", "criticality", "os", "internet_exposed"]
FILTER_FIELDS = ["kind", "severity", "environment", "technique"]
RECENT = 200
TASK_ROWS = 1_000_000  # rows that a task makes for its questions
BROADCAST_LISTS = 1_000
# how Spark says that a path does not exist
NOTHING_THERE = ("PATH_NOT_FOUND", "Input path does not exist", "Path does not exist")
LISTED_VALUES = 1_000
MODEL_ROWS = 100_000  # weights of a model
CELL_ROWS = "_rows"


def severity_level(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_LEVEL.items() for x in pair])
    return F.coalesce(F.try_element_at(known, severity), F.lit(UNKNOWN_LEVEL))


def fp_features(inc: DataFrame, ast: DataFrame) -> DataFrame:
    """Incidents with the profile of their asset, binary label and ordinal
    severity; incidents of unknown assets stay. A stream cannot be looked at ahead for
    hot assets: it is joined batch by batch (:func:`wardlight.streaming.scoring.stream_score`)."""
    if inc.isStreaming:
        raise ValueError("join a stream batch by batch")
    profile = ast.select("asset_id", "environment", "criticality", "os", "internet_exposed")
    return (
        salted_join(inc, profile, ["asset_id"], "left").withColumn("label", (F.lower(strip(F.col("false_positive"))) == "yes").cast("int"))
        .withColumn("severity_level", severity_level(F.col("severity")))
    )


def draw(row_id: str, seed: int = SEED) -> Column:
    """A reproducible 32-bit draw per row."""
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def stratified_split(
    df: DataFrame, label: str, row_id: str, share: float = 0.75, seed: int = SEED
) -> DataFrame:
    """Adds ``part``: exactly ``round(share * n)`` rows of each label are
    ``train``, the rest ``test``.

    Rows are ordered by their draw. Counts over 65,536 draw ranges tell for all
    but one range per label which side it is on; only the rows of that range
    are ranked.
    """
    drawn = df.withColumn("_draw", draw(row_id, seed)).withColumn(
        "_range", F.shiftright("_draw", 16)
    )
    counts = drawn.groupBy(F.col(label).alias("_label"), "_range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_label").orderBy("_range")
    upto = counts.withColumn("_upto", F.sum("n").over(w)).withColumn(
        "_quota",
        F.round(F.sum("n").over(Window.partitionBy("_label")) * F.lit(share), 0).cast("long"),
    )
    edges = small_values(
        upto.where("_upto >= _quota and _upto - n < _quota")
        .select("_label", F.col("_range").alias("_edge"), (F.col("_quota") - F.col("_upto") + F.col("n")).alias("_room")),
        10_000,
    )
    if edges is None:
        raise ValueError("a class label has at most 10,000 values")
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    edge = F.broadcast(  # one row per label, at most 10,000
        spark.createDataFrame([tuple(e) for e in edges], f"_label {kind}, _edge long, _room long")
    )
    placed = drawn.join(edge, drawn[label].eqNullSafe(edge["_label"]), "left").drop("_label")
    side = F.when(F.col("_range") < F.col("_edge"), "train").otherwise("test")
    on_edge = F.coalesce(F.col("_range") == F.col("_edge"), F.lit(False))
    sure = placed.where(~on_edge).withColumn("part", side)
    order = Window.partitionBy(label).orderBy("_draw", row_id)
    ranked = (
        placed.where(on_edge)
        .withColumn("_pos", F.row_number().over(order))
        .withColumn("part", F.when(F.col("_pos") <= F.col("_room"), "train").otherwise("test"))
        .drop("_pos")
    )
    return sure.unionByName(ranked).select(*df.columns, "part")


def fp_stages(rows: int, categories: list[str] = CATEGORIES) -> Pipeline:
    """One-hot categories (unseen ones become zeros), severity as one number,
    logistic regression with unit L2 penalty over ``rows`` rows, which come as cells (see
    :func:`fitting_cells`)."""
    indexed = [f"_{c}_i" for c in categories]
    hot = [f"_{c}_v" for c in categories]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=categories, outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep", dropLast=True),
            VectorAssembler(inputCols=["severity_level", *hot], outputCol="features"),
            LogisticRegression(
                maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False,
                labelCol="label", featuresCol="features", weightCol=CELL_ROWS,
            ),
        ]
    )


def fitting_cells(train: DataFrame, *kept: str) -> DataFrame:
    """What a fit needs of its rows: each combination of features and label (and ``kept``) once, with
    its number of rows. A row's loss depends on these alone, so the weighted fit has the same
    optimum, and its passes read cells instead of rows."""
    cells = train.groupBy(*CATEGORIES, "severity_level", "label", *kept).agg(F.count("*").cast("double").alias(CELL_ROWS))
    return materialise(cells)


def fit_fp(train: DataFrame) -> PipelineModel:
    cells = fitting_cells(train)
    rows = cells.agg(F.sum(CELL_ROWS)).first()[0] or 0
    return fp_stages(int(rows)).fit(cells)


@dataclass
class LinearModel:
    """A fitted model as a table: (feature, value, weight), with a null value for whatever
    value of a category the fit did not see, or null; numbers and the intercept have
    no value either. It scores by a column expression, in any engine that can read the table."""

    rows: list[tuple[str, str | None, float]]

    @classmethod
    def of(cls, fitted: PipelineModel, categories: list[str] = CATEGORIES, numbers: tuple[str, ...] = ("severity_level",)):
        index, _, _, regression = fitted.stages
        weights = iter(regression.coefficients.toArray().tolist())
        rows = [("intercept", None, float(regression.intercept))]
        rows += [(n, None, next(weights)) for n in numbers]
        for category, labels in zip(categories, index.labelsArray):
            rows += [(category, value, next(weights)) for value in [*labels, None]]
        return cls(rows)

    @classmethod
    def read(cls, table: DataFrame) -> LinearModel:
        found = small_values(table.select("feature", "value", "weight"), MODEL_ROWS)
        if found is None:
            raise ValueError(f"a model has at most {MODEL_ROWS} weights")
        return cls([tuple(r) for r in found])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "feature string, value string, weight double")

    def score(self) -> Column:
        """The linear predictor."""
        known: dict[str, list] = {}
        out = F.lit(0.0)
        for feature, value, weight in self.rows:
            if value is not None:
                known.setdefault(feature, []).extend([F.lit(value), F.lit(weight)])
        for feature, value, weight in self.rows:
            if value is not None:
                continue
            if feature == "intercept":
                out += F.lit(weight)
            elif feature in known:
                found = F.try_element_at(F.create_map(*known.pop(feature)), F.col(feature))
                out += F.coalesce(found, F.lit(weight))
            else:
                out += F.lit(weight) * F.col(feature)
        for feature, pairs in known.items():  # without a weight for other values: nothing
            out += F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(feature)), F.lit(0.0))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p``."""
        return df.withColumn("p", 1.0 / (1.0 + F.exp(-self.score())))


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability").getItem(1))


def scored_by(model: PipelineModel | LinearModel, df: DataFrame) -> DataFrame:
    """``df`` with ``p``, the probability of a false positive."""
    return model.transform(df) if isinstance(model, LinearModel) else probability(model.transform(df))


def fit_gaps(train: DataFrame, model: LinearModel, categories: list[str] = CATEGORIES) -> DataFrame:
    """Per value of each category: rows, false positives, and how far the fit is from its optimum
    (the slope of its objective along that value's weight, per row; zero at the optimum)."""
    n = train.count()
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in categories])
    sums = (
        model.transform(train).select(F.explode(cells).alias("_c"), "label", "p")
        .groupBy("_c.feature", "_c.value")
        .agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positive"), F.sum(F.col("p") - F.col("label")).alias("_s"))
    )
    weights = F.broadcast(model.table(train.sparkSession).withColumnRenamed("value", "_v"))  # MODEL_ROWS at most
    same = (sums["feature"] == weights["feature"]) & sums["value"].eqNullSafe(weights["_v"])
    # the penalty of 1 / n per row on a squared weight
    slope = (F.col("_s") + F.col("weight")) / n
    return sums.join(weights, same).select(sums["feature"], "value", "n_rows", "n_positive", slope.alias("slope"))


def confusion_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined), majority baseline and
    prevalence in percent, from ``label`` and ``prediction`` of 0/1."""
    yes, said = F.col("label") == 1, F.col("prediction") == 1
    counts = pred.agg(
        F.count("*").alias("n"),
        F.count_if(yes & said).alias("tp"),
        F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    positive = ratio(tp + fn, n)
    figures = {
        "accuracy": ratio(n - fp - fn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "baseline": F.greatest(positive, 1 - positive),
        "prevalence": positive,
    }
    return counts.select("n", *[F.round(100 * v, 1).alias(k) for k, v in figures.items()])


def auc(pred: DataFrame, score: str = "p") -> float | None:
    """Area under the curve in percent, from ``label`` and a score: the share of pairs of a positive
    and a negative row in which the positive one has the higher score, equal scores
    counting half. None unless both labels occur.

    Rows are counted by score first; the negatives below a score are a running sum over
    scores, range-partitioned beyond a million of them.
    """
    points = pred.groupBy(F.col(score).alias("_at")).agg(
        F.sum(F.col("label").cast("long")).alias("_yes"), F.sum(1 - F.col("label").cast("long")).alias("_no")
    ).withColumn("_all", F.lit(0))
    ordered = numbered(points, ["_all"], ["_at"], "_n", {"_upto": "_no"})
    won = F.col("_yes") * (F.col("_upto") - F.col("_no") / 2.0)
    row = ordered.agg(F.sum(won).alias("won"), F.sum("_yes").alias("yes"), F.sum("_no").alias("no")).first()
    return round(100 * row["won"] / (row["yes"] * row["no"]), 1) if row["yes"] and row["no"] else None


def binary_metrics(pred: DataFrame, score: str = "p") -> DataFrame:
    return confusion_metrics(pred).withColumn("auc", F.lit(auc(pred, score)).cast("double"))


def fold_f1(pred: DataFrame) -> DataFrame:
    """Per fold of ``label`` and ``prediction``: rows and F1 of the positive class in percent
    (0 when undefined)."""
    yes, said = F.col("label") == 1, F.col("prediction") == 1
    return pred.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.round(
            100 * F.coalesce(F.try_divide(2.0 * F.count_if(yes & said), F.count_if(yes) + F.count_if(said)), F.lit(0.0)), 1
        ).alias("f1"),
    )


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int, seed: int = SEED) -> DataFrame:
    """Adds ``fold``: rows of each label, in the order of their draws, go to equal
    stretches. Draws are counted in 65,536 ranges and a range goes to one fold, so
    folds differ per label by the rows of a range at most."""
    drawn = df.withColumn("_range", F.shiftright(draw(row_id, seed), 16))
    counts = drawn.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_label").orderBy("_r"))
    whole = F.sum("_n").over(Window.partitionBy("_label"))
    placed = counts.select("_label", "_r", F.floor((upto - 1) * folds / whole).cast("int").alias("fold"))
    same = drawn[label].eqNullSafe(placed["_label"]) & (drawn["_range"] == placed["_r"])
    # 65,536 ranges for each of a few labels
    return drawn.join(broadcast_if_small(placed), same).select(*df.columns, "fold")


def cross_validate(train: DataFrame, row_id: str, folds: int = 5, seed: int = SEED) -> float:
    """Mean F1 of the positive class over stratified folds, in percent."""
    cells = fitting_cells(stratified_folds(train, "label", row_id, folds, seed), "fold")
    rows = cells.agg(F.sum(CELL_ROWS)).first()[0] or 0
    judge = MulticlassClassificationEvaluator(
        labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0, weightCol=CELL_ROWS
    )
    fitted = CrossValidator(
        estimator=fp_stages(int(rows)), evaluator=judge,
        estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, foldCol="fold",
    ).fit(cells)
    return round(100 * fitted.avgMetrics[0], 1)


def bayes_ceiling(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Best accuracy and AUC (percent) any model can reach that knows only the
    grouping column. The groups are categories, so their figures fit one row."""
    groups = df.groupBy(by).agg(
        F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").cast("double").alias("n")
    )
    row = groups.agg(
        F.sum("n").alias("total"),
        F.sum("pos").alias("yes"),
        F.sum(F.greatest(F.col("pos"), F.col("n") - F.col("pos"))).alias("right"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("pos") / F.col("n")).alias("order"),
                    F.col("pos"),
                    (F.col("n") - F.col("pos")).alias("neg"),
                )
            )
        ).alias("g"),
    )
    # walk the groups from likely to unlikely; each one wins against the
    # negatives that come later and half of its own
    walked = F.aggregate(
        "g",
        F.struct((F.col("total") - F.col("yes")).alias("left"), F.lit(0.0).alias("won")),
        lambda s, x: F.struct(
            (s["left"] - x["neg"]).alias("left"),
            (s["won"] + x["pos"] * (s["left"] - x["neg"]) + 0.5 * x["pos"] * x["neg"]).alias("won"),
        ),
    )["won"]
    return row.select(
        F.round(100 * F.col("right") / F.col("total"), 1).alias("ceiling_accuracy"),
        F.round(
            F.try_divide(100 * walked, F.col("yes") * (F.col("total") - F.col("yes"))), 1
        ).alias("ceiling_auc"),
    )


def scored_columns(p: Column, threshold: float) -> list[Column]:
    return [
        F.round(p, 3).alias("probability"),
        F.when(p >= threshold, FALSE_ALARM).otherwise(REAL).alias("predicted"),
        F.round(F.greatest(p, 1 - p), 3).alias("confidence"),
    ]


def score_fp(
    model: PipelineModel | LinearModel, df: DataFrame, threshold: float, keep: tuple = ()
) -> DataFrame:
    """Probability of a false positive per incident, class by the prevalence
    threshold, confidence."""
    scored = scored_by(model, df)
    return scored.select("incident_id", *keep, *scored_columns(F.col("p"), threshold))


def ranked(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("probability"), "incident_id")


# --- selection of the incidents a question is about ---------------------------


def match_filters(questions: DataFrame, profile: DataFrame) -> DataFrame:
    """Per question (question_id, question): the values of each filter field
    named in it, ignoring case and accents, and whether it asks for exposed
    assets only."""
    out = questions.withColumn("_folded", fold(F.col("question")))
    for field in FILTER_FIELDS:
        values = profile.where(F.col(field).isNotNull()).select(field).distinct()
        listed = small_values(values.withColumn("_f", fold(F.col(field))), LISTED_VALUES)
        if listed is not None:
            words = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(f).alias("f")) for v, f in sorted(listed)]).cast(
                "array<struct<v: string, f: string>>"
            )
            named = F.filter(words, lambda w: F.contains(F.col("_folded"), w["f"]))
            out = out.withColumn(field, F.transform(named, lambda w: w["v"]))
        else:
            out = _match_many(out, values, field)
    folded = F.col("_folded")
    return out.withColumn(
        "exposed_only", folded.contains("exposto") | folded.contains("internet")
    ).drop("_folded", "question")


def _match_many(questions: DataFrame, values: DataFrame, field: str) -> DataFrame:
    """The same for a field with many values: values are looked up in the
    questions like passages in documents."""
    numbered = values.withColumn("item_id", F.xxhash64(field)).withColumn("text", fold(F.col(field)))
    asked = questions.select(F.col("question_id").alias("doc_id"), F.col("_folded").alias("text"))
    named = (
        containment_gold(numbered.select("item_id", "text"), asked)
        .join(numbered, "item_id")
        .groupBy(F.col("doc_id").alias("question_id"))
        .agg(F.array_sort(F.collect_set(field)).alias(field))
    )
    return questions.join(named, "question_id", "left").withColumn(
        field, F.coalesce(field, F.array().cast("array<string>"))
    )


def _cell(pattern: Column, fields: dict[str, Column], exposed: Column) -> Column:
    parts = [
        F.when(pattern.bitwiseAND(F.lit(1 << i)) > 0, value).otherwise("*")
        for i, value in enumerate(fields.values())
    ]
    return F.concat_ws("\u0001", pattern.cast("string"), *parts, exposed)


def asked_cells(filters: DataFrame) -> DataFrame:
    """One row per question and combination of named values. ``pattern`` says
    which fields are restricted (bit per field, the last for exposure)."""
    pattern = reduce(
        lambda a, b: a + b,
        [F.when(F.size(f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTER_FIELDS)],
    ) + F.when(F.col("exposed_only"), 1 << len(FILTER_FIELDS)).otherwise(0)
    out = filters.withColumn("pattern", pattern)
    for f in FILTER_FIELDS:
        out = out.withColumn(
            f, F.explode(F.when(F.size(f) > 0, F.col(f)).otherwise(F.array(F.lit("*"))))
        )
    exposed = F.when(F.col("exposed_only"), "Yes").otherwise("*")
    cell = _cell(F.col("pattern"), {f: F.col(f) for f in FILTER_FIELDS}, exposed)
    return out.select("question_id", "pattern", cell.alias("cell"))


def _profile_cells(profile: DataFrame, cells: DataFrame) -> DataFrame:
    """Profile rows repeated once per restriction pattern in use (at most 32),
    kept where some question asks for the cell."""
    patterns = [r["pattern"] for r in cells.select("pattern").distinct().collect()]
    exposed_bit = 1 << len(FILTER_FIELDS)
    exposed = F.when(
        F.col("pattern").bitwiseAND(F.lit(exposed_bit)) > 0, F.col("internet_exposed")
    ).otherwise("*")
    spread = profile.withColumn(
        "pattern", F.explode(F.array(*[F.lit(p) for p in patterns]).cast("array<int>"))
    ).withColumn(
        "cell", _cell(F.col("pattern"), {f: F.col(f) for f in FILTER_FIELDS}, exposed)
    )
    # asked cells are few; a question without filters asks for one that all incidents hold,
    # so incidents should not be shuffled by cell
    return spread.join(broadcast_if_small(cells.select("cell").distinct()), "cell", "left_semi")


def selection_counts(filters: DataFrame, profile: DataFrame) -> DataFrame:
    """Number of matching incidents per question, 0 for contradictory filters.
    Incidents are counted per cell, questions add up their cells."""
    cells = materialise(asked_cells(filters))
    held = _profile_cells(profile, cells).groupBy("cell").agg(F.count("*").alias("n"))
    return (
        cells.join(held, "cell", "left")
        .groupBy("question_id")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_incidents"))
    )


def select_recent(filters: DataFrame, profile: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` most recent matching incidents of each question. A question's
    cells do not overlap, so the n latest of each cell are enough. Questions that ask for
    the same cells get the same incidents, which are ranked once for all of them; no task
    sorts the rows per question, and none makes many more than ``TASK_ROWS`` of them."""
    cells = materialise(asked_cells(filters))
    order = [F.desc("opened_on"), F.desc("incident_id")]
    latest = top_per_group(_profile_cells(profile, cells), ["cell"], order, n, "_r").drop(
        "_r", "pattern"
    )
    # rows of one question id are one question; n rows of a cell fill the answer, however often it is asked for
    times = cells.groupBy("question_id", "cell").agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("times"))
    listed = times.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("cell", "times"))).alias("_cells"))
    asked = materialise(listed.withColumn("_selection", F.sha2(F.to_json("_cells"), 256)))
    selections = asked.groupBy("_selection").agg(F.first("_cells").alias("_cells"))
    found = selections.select("_selection", F.inline("_cells")).join(latest, "cell")
    repeated = found.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
    picked = most_recent(repeated, "_selection", n)
    rows = F.collect_list(F.struct(*[c for c in picked.columns if c != "_selection"])).alias("_rows")
    lists = materialise(picked.groupBy("_selection").agg(rows))
    asked = asked.select("question_id", "_selection")
    if at_most(lists, BROADCAST_LISTS):  # of n rows each
        parts = max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() * n // TASK_ROWS))
        answered = asked.repartition(parts, "question_id").join(F.broadcast(lists), "_selection")
    else:
        answered = salted_join(asked, lists, ["_selection"], hot_rows=max(1, TASK_ROWS // n))
    return answered.select("question_id", F.inline("_rows"))


def most_recent(df: DataFrame, by: str, n: int = RECENT) -> DataFrame:
    order = [F.desc("opened_on"), F.desc("incident_id")]
    return top_per_group(df, [by], order, n, "recency").drop("cell")


def score_summary(scored: DataFrame, top: int = 5) -> DataFrame:
    """Per question over scored incidents: number, mean probability, mean per
    severity (highest first) and the ``top`` likeliest."""
    per_severity = scored.groupBy("question_id", "severity").agg(
        F.sum("probability").alias("total"), F.count("*").alias("n")
    )
    best = scored.select("question_id", "incident_id", "probability")
    return _summary(per_severity, best, top)


def selection_summary(filters: DataFrame, scored_profile: DataFrame, top: int = 5) -> DataFrame:
    """``score_summary`` over the whole selection of each question, however large.
    Incidents are added up and ranked per cell; questions add up their cells, so no
    row is made per question and incident."""
    cells = materialise(asked_cells(filters))
    held = _profile_cells(scored_profile, cells)
    asked = cells.select("question_id", "cell")
    sums = held.groupBy("cell", "severity").agg(F.sum("probability").alias("total"), F.count("*").alias("n"))
    per_severity = asked.join(sums, "cell").groupBy("question_id", "severity").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    order = [F.desc("probability"), "incident_id"]
    kept = top_per_group(held.select("cell", "incident_id", "probability"), ["cell"], order, top, "_r").drop("_r")
    return _summary(per_severity, asked.join(kept, "cell").drop("cell"), top)


def _summary(per_severity: DataFrame, best: DataFrame, top: int) -> DataFrame:
    mean = F.col("total") / F.col("n")
    line = F.concat(
        "severity", F.lit(": "), F.round(100 * mean, 0).cast("long").cast("string"),
        F.lit("% (n="), F.col("n").cast("string"), F.lit(")"),
    )
    overall = per_severity.groupBy("question_id").agg(
        F.sum("n").alias("n"),
        F.round(F.sum("total") / F.sum("n"), 3).alias("mean_probability"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct((-F.round(mean, 6)).alias("o"), F.col("severity"), line.alias("line"))
                    )
                ),
                lambda s: s["line"],
            ),
            ", ",
        ).alias("by_severity"),
    )
    ranked_ = top_per_group(best, ["question_id"], [F.desc("probability"), "incident_id"], top, "_r")
    item = F.concat(
        F.col("incident_id").cast("string"), F.lit(" ("),
        F.round(100 * F.col("probability"), 0).cast("long").cast("string"), F.lit("%)"),
    )
    likeliest = ranked_.groupBy("question_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_r", item.alias("item")))), lambda s: s["item"]
            ),
            ", ",
        ).alias("likeliest")
    )
    return overall.join(likeliest, "question_id")


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest AUC; ties go to the first name."""
    return metrics.agg(
        F.min_by(F.struct("model", "auc", "f1"), F.struct(-F.col("auc"), "model")).alias("_b")
    ).select("_b.*")


def save_model(model: LinearModel, metrics: DataFrame, path: str) -> None:
    """The model's table and its metrics, as Parquet and JSON."""
    model.table(metrics.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.read(spark.read.parquet(f"{path}/model"))


def load_or_fit(spark: SparkSession, path: str, frame: DataFrame) -> tuple[LinearModel, DataFrame]:
    """The saved model with its metrics; a new one, fitted on ``frame`` and saved, when
    nothing is there. Any other failure to load is the caller's to see."""
    try:
        return load_model(spark, path), spark.read.json(f"{path}/metrics")
    except (PySparkException, Py4JJavaError) as failed:
        if not any(mark in str(failed) for mark in NOTHING_THERE):
            raise
    model, metrics = train_fp(frame)
    save_model(model, metrics, path)
    return model, metrics


def train_fp(frame: DataFrame) -> tuple[LinearModel, DataFrame]:
    """Split, fit, measure on the held-out part; the ceiling, the threshold
    (prevalence) and the numbers of rows come from all rows. The features are written once
    for all passes over them."""
    parts = materialise(stratified_split(frame, "label", "incident_id"))
    train, test = (parts.where(F.col("part") == part) for part in ("train", "test"))
    fitted = fit_fp(train)
    whole = parts.agg(
        F.avg("label").alias("share"), F.count("*").alias("n"), F.count_if(F.col("part") == "train").alias("n_train")
    ).first()
    ceiling = bayes_ceiling(parts, "severity").first()
    metrics = binary_metrics(probability(fitted.transform(test))).select(
        F.lit("LogisticRegression").alias("model"),
        F.lit(whole["n"]).alias("n_total"),
        F.lit(whole["n_train"]).alias("n_train"),
        F.col("n").alias("n_test"),
        F.lit(round(100 * whole["share"], 1)).alias("fp_pct"),
        "*",
        F.lit(cross_validate(train, "incident_id")).alias("cv_f1"),
        F.lit(round(whole["share"], 3)).alias("threshold"),
        F.lit(ceiling["ceiling_accuracy"]).alias("ceiling_accuracy"),
        F.lit(ceiling["ceiling_auc"]).alias("ceiling_auc"),
    ).drop("n")
    return LinearModel.of(fitted), metrics
