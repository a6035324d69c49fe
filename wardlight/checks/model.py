"""ML-1..13."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.sources import connections
from wardlight.checks.views_sql import over
from wardlight.operators import fp_model as m
from wardlight.operators import intrusion
from wardlight.plans.session import materialise, scratch_path

_FRAME = """f AS (SELECT incident_id, i.asset_id, opened_on, kind, severity, technique, environment, criticality, os, internet_exposed,
 CASE WHEN false_positive = 'Yes' THEN 1 ELSE 0 END AS label,
 CASE severity WHEN 'Low' THEN 0 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 ELSE 1 END AS severity_level
 FROM incident i LEFT JOIN asset a USING (asset_id))"""
# a rule-based score stands in for the model where values are compared
_SCORE = "((incident_id * 37) % 1000) / 1000.0"


def frame(t):
    return m.fp_features(t.incident, t.asset)


def _parts(t):
    return m.stratified_split(frame(t), "label", "incident_id")


@check("ml_01_fp_features", over("asset incident", f"""WITH {_FRAME}
SELECT incident_id, kind, severity, technique, environment, criticality, os, internet_exposed, label, severity_level FROM f"""))
def _(t):
    return frame(t).select("incident_id", "kind", "severity", "technique", "environment", "criticality",
                           "os", "internet_exposed", "label", "severity_level")


@check("ml_02_stratified_split", over("asset incident", f"""WITH {_FRAME},
d AS (SELECT incident_id, label, CAST('0x' || substr(md5(CAST(incident_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) AS dr FROM f)
SELECT incident_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY dr, incident_id)
 <= round(0.75 * count(*) OVER (PARTITION BY label), 0) THEN 'train' ELSE 'test' END AS part FROM d"""))
def _(t):
    return _parts(t).select("incident_id", "label", "part")


# at the optimum the objective has no slope along any weight
@check("ml_03_fit_fp", over("asset incident", f"""WITH {_FRAME},
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, label FROM f" for c in m.CATEGORIES)})
SELECT feature, value, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, CAST(0 AS DOUBLE) AS slope FROM c GROUP BY 1, 2"""))
def _(t):
    rows = materialise(frame(t))
    gaps = m.fit_gaps(rows, m.LinearModel.of(m.fit_fp(rows)))
    return gaps.withColumn("slope", F.round(F.abs("slope"), 3))


# a model that SQL can spell: weights by rule of the value's text
def _rule_weight(value):
    return f"((length({value}) * 7 + ascii({value})) % 11 - 5) / 10.0"


_SAVED_SCORE = "1 / (1 + exp(-(-0.8 - 0.3 * severity_level + " + " + ".join(
    f"coalesce({_rule_weight(c)}, 0.15)" for c in m.CATEGORIES) + ")))"
SAVED = over("asset incident", f"""WITH {_FRAME}, p AS (SELECT incident_id, CAST({_SAVED_SCORE} AS DOUBLE) AS p FROM f)
SELECT incident_id, round(p, 3) AS probability, CASE WHEN p >= 0.239 THEN 'falso positivo' ELSE 'incidente real' END AS predicted,
 round(greatest(p, 1 - p), 3) AS confidence FROM p""")


def saved_model(t):
    """A model by rule, saved as a table; the path it is saved under."""
    values = frame(t).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in m.CATEGORIES])).alias("c")
    ).select("c.*").where("value IS NOT NULL").distinct()
    weights = values.withColumn("weight", F.expr(_rule_weight("value").replace("10.0", "10.0D"))).collect()
    rows = [("intercept", None, -0.8), ("severity_level", None, -0.3)]
    model = m.LinearModel(rows + [(c, None, 0.15) for c in m.CATEGORIES] + [tuple(r) for r in weights])
    path = scratch_path(t.spark, "model")
    m.save_model(model, frame(t).agg(F.lit(0.239).alias("threshold"), F.count("*").alias("n_total")), path)
    return path


@check("ml_04_confusion_metrics", over("asset incident", f"""WITH {_FRAME},
c AS (SELECT label AS y, CASE WHEN severity IN ('Low', 'Medium') THEN 1 ELSE 0 END AS s FROM f),
k AS (SELECT count(*) AS n, CAST(sum(y * s) AS DOUBLE) AS tp, CAST(sum((1 - y) * s) AS DOUBLE) AS fp, CAST(sum(y * (1 - s)) AS DOUBLE) AS fn FROM c)
SELECT n, round(100 * ((n - fp - fn) / n), 1) AS accuracy, round(100 * (tp / (tp + fp)), 1) AS precision, round(100 * (tp / (tp + fn)), 1) AS recall,
 round(100 * (2 * tp / (2 * tp + fp + fn)), 1) AS f1, round(100 * greatest((tp + fn) / n, 1 - (tp + fn) / n), 1) AS baseline,
 round(100 * ((tp + fn) / n), 1) AS prevalence FROM k"""))
def _(t):
    return m.confusion_metrics(
        frame(t).withColumn("prediction", F.col("severity").isin("Low", "Medium").cast("int"))
    )


_RULE_P = "(severity_level * 31 + length(kind) * 17 + incident_id * 37) % 1000"
_AUC = """(SELECT round(100 * sum(yes * (below + no / 2.0)) / (sum(yes) * sum(no)), 1) FROM
 (SELECT *, sum(no) OVER (ORDER BY p) - no AS below FROM
  (SELECT p, CAST(sum({y}) AS DOUBLE) AS yes, CAST(sum(1 - {y}) AS DOUBLE) AS no FROM {rows} GROUP BY p)))"""
_CONFUSION = """SELECT n, round(100 * ((n - fp - fn) / n), 1) AS accuracy, round(100 * coalesce(tp / nullif(tp + fp, 0), 0), 1) AS precision,
 round(100 * coalesce(tp / nullif(tp + fn, 0), 0), 1) AS recall, round(100 * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 1) AS f1,
 round(100 * greatest((tp + fn) / n, 1 - (tp + fn) / n), 1) AS baseline, round(100 * ((tp + fn) / n), 1) AS prevalence"""
_COUNTED = """k AS (SELECT count(*) AS n, CAST(sum({y} * s) AS DOUBLE) AS tp, CAST(sum((1 - {y}) * s) AS DOUBLE) AS fp,
 CAST(sum({y} * (1 - s)) AS DOUBLE) AS fn FROM {rows})"""


@check("ml_04_binary_metrics", over("asset incident", f"""WITH {_FRAME},
c AS (SELECT label, {_RULE_P} AS p, CASE WHEN {_RULE_P} >= 600 THEN 1 ELSE 0 END AS s FROM f), {_COUNTED.format(y="label", rows="c")}
{_CONFUSION}, {_AUC.format(y="label", rows="c")} AS auc FROM k"""))
def _(t):
    rows = frame(t).withColumn("p", F.expr(_RULE_P))
    return m.binary_metrics(rows.withColumn("prediction", (F.col("p") >= 600).cast("int")))


@check("ml_04_fitted_metrics")
def _(t):
    parts = materialise(_parts(t))
    fitted = m.fit_fp(parts.where("part = 'train'"))
    return m.binary_metrics(m.probability(fitted.transform(parts.where("part = 'test'"))))


# folds are stretches of the draws' 65,536 ranges, by label
_FOLDS = """d AS (SELECT *, CAST('0x' || substr(md5(CAST(incident_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) // 65536 AS r FROM f),
rc AS (SELECT label AS l, r, count(*) AS n FROM d GROUP BY 1, 2),
rf AS (SELECT l, r, CAST(floor((sum(n) OVER (PARTITION BY l ORDER BY r) - 1) * 5 / sum(n) OVER (PARTITION BY l)) AS INTEGER) AS fold FROM rc)"""


@check("ml_05_fold_f1", over("asset incident", f"""WITH {_FRAME}, {_FOLDS},
c AS (SELECT fold, label AS y, CASE WHEN severity IN ('Low', 'Medium') THEN 1 ELSE 0 END AS s FROM d JOIN rf ON l = label AND rf.r = d.r)
SELECT fold, count(*) AS n, round(100 * coalesce(2.0 * sum(y * s) / nullif(sum(y) + sum(s), 0), 0), 1) AS f1 FROM c GROUP BY 1"""))
def _(t):
    folded = m.stratified_folds(frame(t), "label", "incident_id", 5)
    return m.fold_f1(folded.withColumn("prediction", F.col("severity").isin("Low", "Medium").cast("int")))


@check("ml_05_cross_validate")
def _(t):
    rows = materialise(_parts(t))
    mean_f1 = m.cross_validate(rows.where("part = 'train'"), "incident_id")
    return rows.agg(F.count("*").alias("n")).withColumn("cv_f1", F.lit(mean_f1))


@check("ml_06_bayes_ceiling", over("asset incident", f"""WITH {_FRAME},
g AS (SELECT severity AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg FROM f GROUP BY 1),
tt AS (SELECT sum(pos) AS p, sum(neg) AS q, sum(greatest(pos, neg)) AS r FROM g),
pr AS (SELECT sum(CASE WHEN a.s = b.s THEN 0.5 WHEN a.pos / (a.pos + a.neg) > b.pos / (b.pos + b.neg) THEN 1.0 ELSE 0.0 END * a.pos * b.neg) AS won
 FROM g a CROSS JOIN g b)
SELECT round(100 * r / (p + q), 1) AS ceiling_accuracy, round(100 * won / (p * q), 1) AS ceiling_auc FROM tt CROSS JOIN pr"""))
def _(t):
    return m.bayes_ceiling(frame(t), "severity")


@check("ml_07_score_rule", over("asset incident", f"""
SELECT incident_id, round({_SCORE}, 3) AS probability, CASE WHEN {_SCORE} >= 0.239 THEN 'falso positivo' ELSE 'incidente real' END AS predicted,
 round(greatest({_SCORE}, 1 - {_SCORE}), 3) AS confidence FROM (SELECT CAST(incident_id AS DOUBLE) AS incident_id FROM incident)""").replace(
     "SELECT incident_id, round", "SELECT CAST(incident_id AS BIGINT) AS incident_id, round"))
def _(t):
    p = F.expr("((incident_id * 37) % 1000) / 1000.0D")
    return t.incident.select("incident_id", *m.scored_columns(p, 0.239))


@check("ml_07_score_fp", SAVED)
def _(t):
    return m.score_fp(m.load_model(t.spark, saved_model(t)), frame(t), 0.239)


@check("ml_07_fit_and_score")
def _(t):
    rows = materialise(frame(t))  # read by the count, the indexers and each step of the fit
    return m.ranked(m.score_fp(m.LinearModel.of(m.fit_fp(rows)), rows, 0.239, ("severity",)))


# questions: every conversation turn, with words that name values put in front of some
_QUESTION = """CASE turn % 6 WHEN 0 THEN 'Chance for PHISHING or brute force, severity crítical? '
 WHEN 1 THEN 'expostos na internet: malware ' WHEN 2 THEN 'MACHINERY with T1190 ' WHEN 3 THEN 'Phishing by T1498 '
 WHEN 4 THEN 'low and high building ' ELSE '' END"""
_ASK = f"""q AS (SELECT conv_id * 100 + turn AS question_id, strip_accents(lower({_QUESTION} || text)) AS fq FROM conversations),
x AS (SELECT *, contains(fq, 'exposto') OR contains(fq, 'internet') AS exposed_only FROM q)"""


def _vals(field, table):
    return (f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {field} AS v FROM {table}) w "
            f"WHERE contains(fq, lower(v)))")


def questions(t):
    return t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.concat(F.expr(_QUESTION), "text").alias("question"),
    )


_MATCHED = f"""{_FRAME}, {_ASK}, mt AS (SELECT question_id, exposed_only, coalesce({_vals('kind', 'f')}, '') AS kind, coalesce({_vals('severity', 'f')}, '') AS severity,
 coalesce({_vals('environment', 'f')}, '') AS environment, coalesce({_vals('technique', 'f')}, '') AS technique FROM x)"""
_COND = " AND ".join(f"(mt.{f} = '' OR contains('|' || mt.{f} || '|', '|' || f.{f} || '|'))" for f in m.FILTER_FIELDS)
_PICKED = f"""pk AS (SELECT question_id, f.*, row_number() OVER (PARTITION BY question_id ORDER BY opened_on DESC, incident_id DESC) AS rc
 FROM mt JOIN f ON {_COND} AND (NOT exposed_only OR internet_exposed = 'Yes'))"""


@check("ml_08_match_filters", over("asset incident", f"""WITH {_MATCHED}
SELECT question_id, exposed_only, kind, severity, environment, technique FROM mt"""))
def _(t):
    found = m.match_filters(questions(t), frame(t))
    return found.withColumns({f: F.array_join(f, "|") for f in m.FILTER_FIELDS})


@check("ml_08_selection_counts", over("asset incident", f"""WITH {_MATCHED}
SELECT question_id, count(f.incident_id) AS n_incidents FROM mt LEFT JOIN f ON {_COND}
 AND (NOT exposed_only OR internet_exposed = 'Yes') GROUP BY 1"""))
def _(t):
    rows = frame(t)
    return m.selection_counts(m.match_filters(questions(t), rows), rows)


@check("ml_09_most_recent", over("asset incident", f"""WITH {_MATCHED}, {_PICKED}
SELECT question_id, incident_id, opened_on, severity FROM pk WHERE rc <= 200"""))
def _(t):
    rows = frame(t)
    picked = m.select_recent(m.match_filters(questions(t), rows), rows)
    return picked.select("question_id", "incident_id", "opened_on", "severity")


@check("ml_10_score_summary", over("asset incident", f"""WITH {_MATCHED}, {_PICKED},
sc AS (SELECT question_id, incident_id, severity, round(((incident_id * 37) % 1000) / CAST(1000 AS DOUBLE), 3) AS p FROM pk WHERE rc <= 200),
sv AS (SELECT question_id, severity, sum(p) AS total, count(*) AS n FROM sc GROUP BY 1, 2),
ov AS (SELECT question_id, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 3) AS mean_probability,
 string_agg(severity || ': ' || CAST(CAST(round(100 * (total / n), 0) AS BIGINT) AS VARCHAR) || '% (n=' || CAST(n AS VARCHAR) || ')', ', '
  ORDER BY round(total / n, 6) DESC, severity) AS by_severity FROM sv GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, incident_id) AS r FROM sc),
tp AS (SELECT question_id, string_agg(CAST(incident_id AS VARCHAR) || ' (' || CAST(CAST(round(100 * p, 0) AS BIGINT) AS VARCHAR) || '%)', ', ' ORDER BY r) AS likeliest
 FROM rk WHERE r <= 5 GROUP BY 1)
SELECT question_id, n, mean_probability, by_severity, likeliest FROM ov JOIN tp USING (question_id)"""))
def _(t):
    rows = frame(t)
    picked = m.select_recent(m.match_filters(questions(t), rows), rows)
    scored = picked.withColumn("probability", F.expr("round(((incident_id * 37) % 1000) / 1000.0D, 3)"))
    return m.score_summary(scored)


@check("ml_10_selection_summary", over("asset incident", f"""WITH {_MATCHED}, {_PICKED},
sc AS (SELECT question_id, incident_id, severity, round(((incident_id * 37) % 997) / CAST(997 AS DOUBLE), 3) AS p FROM pk),
sv AS (SELECT question_id, severity, sum(p) AS total, count(*) AS n FROM sc GROUP BY 1, 2),
ov AS (SELECT question_id, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 3) AS mean_probability,
 string_agg(severity || ': ' || CAST(CAST(round(100 * (total / n), 0) AS BIGINT) AS VARCHAR) || '% (n=' || CAST(n AS VARCHAR) || ')', ', '
  ORDER BY round(total / n, 6) DESC, severity) AS by_severity FROM sv GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, incident_id) AS r FROM sc),
tp AS (SELECT question_id, string_agg(CAST(incident_id AS VARCHAR) || ' (' || CAST(CAST(round(100 * p, 0) AS BIGINT) AS VARCHAR) || '%)', ', ' ORDER BY r) AS likeliest
 FROM rk WHERE r <= 5 GROUP BY 1)
SELECT question_id, n, mean_probability, by_severity, likeliest FROM ov JOIN tp USING (question_id)"""))
def _(t):
    rows = frame(t)
    scored = rows.withColumn("probability", F.expr("round(((incident_id * 37) % 997) / 997.0D, 3)"))
    return m.selection_summary(m.match_filters(questions(t), rows), scored)


def _kdd_parts(t):
    records = connections(t).withColumn("attack", (F.col("label") != "normal").cast("int"))
    held = m.draw("row_id") % 4 == 0
    return records.where(~held).drop("row_id"), records.where(held).drop("row_id")


# a score by rule in place of a fitted one: many ties, better than chance
_KDD_TEST = """c AS (SELECT CASE WHEN l_quantity > 30 AND l_discount < 0.07 THEN 1 ELSE 0 END AS y, l_quantity * 3 + l_linenumber % 22 AS p,
 CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || ':42'), 1, 8) AS BIGINT) % 4 = 0 AS held FROM lineitem),
e AS (SELECT y, p, CASE WHEN p >= 95 THEN 1 ELSE 0 END AS s FROM c WHERE held)"""


@check("ml_11_kdd_evaluation", f"""WITH {_KDD_TEST}, {_COUNTED.format(y="y", rows="e")}, b AS ({_CONFUSION} FROM k)
SELECT 'LogisticRegression' AS model, (SELECT count(*) FROM c WHERE NOT held) AS n_train, n AS n_test,
 (SELECT round(100 * avg(y), 1) FROM c WHERE NOT held) AS train_attack_pct, prevalence AS test_attack_pct,
 baseline, accuracy, precision, recall, f1, {_AUC.format(y="y", rows="e")} AS auc FROM b""")
def _(t):
    train, test = _kdd_parts(t)
    scored = test.withColumn("p", F.col("duration") * 3 + F.col("difficulty"))
    return intrusion.measured_kdd(scored.withColumn("prediction", (F.col("p") >= 95).cast("int")), train, "logistic")


@check("ml_11_kdd_logistic")
def _(t):
    train, test = _kdd_parts(t)
    fitted = intrusion.fit_kdd(train, "logistic")
    return intrusion.evaluate_kdd(fitted, train, test, "logistic")


@check("ml_11_kdd_boosting")
def _(t):
    train, test = _kdd_parts(t)
    fitted = intrusion.fit_kdd(train, "boosting")
    return intrusion.evaluate_kdd(fitted, train, test, "boosting")


@check("ml_12_load_or_fit", SAVED)
def _(t):
    rows = frame(t)
    model, metrics = m.load_or_fit(t.spark, saved_model(t), rows)
    return m.score_fp(model, rows, metrics.first()["threshold"])


@check("ml_12_fit_then_load")
def _(t):
    path, rows = scratch_path(t.spark, "model"), materialise(frame(t))
    m.load_or_fit(t.spark, path, rows)
    model, metrics = m.load_or_fit(t.spark, path, rows)
    return m.score_fp(model, rows, metrics.first()["threshold"])


@check("ml_13_best_model", over("asset incident", f"""WITH {_FRAME},
g AS (SELECT kind AS model, round(100 * avg(label), 1) AS auc, round(avg(severity_level), 1) AS f1 FROM f GROUP BY 1)
SELECT model, auc, f1 FROM g ORDER BY auc DESC, model LIMIT 1"""))
def _(t):
    metrics = frame(t).groupBy(F.col("kind").alias("model")).agg(
        F.round(100 * F.avg("label"), 1).alias("auc"), F.round(F.avg("severity_level"), 1).alias("f1")
    )
    return m.best_model(metrics)
