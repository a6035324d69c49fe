import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import fp_model, intrusion
from wardlight.sources import kdd


@pytest.fixture(scope="module")
def labelled(tables):
    return fp_model.fp_features(tables.incident, tables.asset).cache()


def test_split_is_exact_and_repeatable(labelled):
    a = fp_model.stratified_split(labelled, "label", "incident_id")
    n = {(r["label"], r["part"]): r["count"] for r in a.groupBy("label", "part").count().collect()}
    total = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    for label, count in total.items():
        assert n[(label, "train")] == int(count * 0.75 + 0.5)
    assert a.count() == labelled.count()
    b = fp_model.stratified_split(labelled, "label", "incident_id")
    assert a.exceptAll(b).count() == 0


def test_ceiling_of_known_rates(frame):
    rows = []
    for severity, rate in (("Low", 55), ("Medium", 30), ("High", 12), ("Critical", 4)):
        rows += [(severity, int(i < rate)) for i in range(100)]
    row = fp_model.bayes_ceiling(frame(rows, "severity string, label int"), "severity").first()
    assert row["ceiling_accuracy"] == pytest.approx((55 + 70 + 88 + 96) / 4, abs=0.051)
    by = {"Low": (55, 45), "Medium": (30, 70), "High": (12, 88), "Critical": (4, 96)}
    groups = list(by.values())
    won = sum(a[0] * b[1] * (1 if i < j else 0.5 if i == j else 0) for i, a in enumerate(groups) for j, b in enumerate(groups))
    assert row["ceiling_auc"] == round(100 * won / (101 * 299), 1)


def test_train_save_load(spark, labelled, tmp_path):
    model, metrics = fp_model.load_or_fit(spark, str(tmp_path / "m"), labelled)
    row = metrics.first()
    assert 50.0 < row["auc"] <= row["ceiling_auc"] + 5 and row["accuracy"] <= row["ceiling_accuracy"] + 5
    again, saved = fp_model.load_or_fit(spark, str(tmp_path / "m"), labelled)
    assert saved.first()["threshold"] == row["threshold"]
    assert row["n_total"] == labelled.count() == row["n_train"] + row["n_test"]
    assert row["fp_pct"] == pytest.approx(100 * row["threshold"], abs=0.06)
    low = ("calm", "DDoS", "Low", "T1498", "FURNITURE", "Low", "OS-3", "No")
    critical = ("hot", "Phishing", "Critical", "T1566", "AUTOMOBILE", "Medium", "OS-4", "Yes")
    odd = ("odd", "Never Seen", "High", "T0000", "Nowhere", "High", "OS-99", "No")
    ddl = "incident_id string, kind string, severity string, technique string, environment string, criticality string, os string, internet_exposed string"
    df = spark.createDataFrame([critical, low, odd], ddl).withColumn("severity_level", fp_model.severity_level(F.col("severity")))
    got = fp_model.ranked(fp_model.score_fp(again, df, row["threshold"])).collect()
    assert [r["probability"] for r in got] == sorted((r["probability"] for r in got), reverse=True)
    p = {r["incident_id"]: r["probability"] for r in got}
    assert p["calm"] > p["hot"] and 0 <= p["odd"] <= 1
    assert all(0.5 <= r["confidence"] <= 1 for r in got)
    first = fp_model.score_fp(model, df, 0.2).collect()
    assert sorted(first) == sorted(fp_model.score_fp(again, df, 0.2).collect())


def test_unknown_severity(frame):
    df = frame([("Low",), ("odd",), (None,), ("Critical",)], "s string")
    assert [r[0] for r in df.select(fp_model.severity_level(F.col("s"))).collect()] == [0, 1, 1, 3]


def test_metrics_without_positives(frame):
    row = fp_model.confusion_metrics(frame([(0, 0.0), (0, 0.0)], "label int, prediction double")).first()
    assert (row["accuracy"], row["precision"], row["f1"], row["baseline"]) == (100.0, 0.0, 0.0, 100.0)


def asked(frame, *texts):
    return frame(list(enumerate(texts)), "question_id int, question string")


def test_filters(frame):
    rows = [
        (1, "Engenharia Social", "Baixa", "T1598", "DMZ", "Yes", "2026-01-01"),
        (2, "Malware", "Critica", "T1203", "Producao", "No", "2026-01-02"),
        (3, "Malware", "Baixa", "T1203", "DMZ", "Yes", "2026-01-03"),
    ]
    profile = frame(rows, "incident_id int, kind string, severity string, technique string, environment string, internet_exposed string, day string").withColumn("opened_on", F.to_date("day"))
    questions = asked(frame, "malware de severidade crítica ou BAIXA", "Malware com T1598", "ataques quânticos", "expostos na internet", "engenharia social e malware")
    found = fp_model.match_filters(questions, profile)
    counts = {r["question_id"]: r["n_incidents"] for r in fp_model.selection_counts(found, profile).collect()}
    assert counts == {0: 2, 1: 0, 2: 3, 3: 2, 4: 3}
    recent = fp_model.select_recent(found, profile, 1)
    assert {r["question_id"]: r["incident_id"] for r in recent.collect()} == {0: 3, 2: 3, 3: 3, 4: 3}


def _recent_by_hand(cells, held, n):
    """Question -> its n latest incidents, rows of one id taken together."""
    asked = {}
    for question, cell in cells:
        asked.setdefault(question, []).extend(held.get(cell, []))
    return {q: sorted(rows, reverse=True)[:n] for q, rows in asked.items() if rows}


@pytest.mark.parametrize("lists", [0, 1_000])
def test_recent_of_repeated_and_missing_question_ids(frame, monkeypatch, lists):
    monkeypatch.setattr(fp_model, "BROADCAST_LISTS", lists)
    profile = frame(
        [(i, f"2024-01-{1 + i % 9:02d}", "ab"[i % 2], "Low", "T1", "prod", "Yes") for i in range(40)],
        "incident_id long, opened_on string, kind string, severity string, technique string, environment string, internet_exposed string",
    )
    named = [(1, ["a"]), (1, ["a"]), (2, ["a", "b"]), (3, []), (None, ["b"]), (None, ["a"]), (4, ["b"]), (5, ["c"]), (6, ["b"])]
    filters = frame(
        [(q, kinds, [], [], [], False) for q, kinds in named],
        "question_id long, kind array<string>, severity array<string>, environment array<string>, technique array<string>, exposed_only boolean",
    )
    got = {}
    for r in fp_model.select_recent(filters, profile, 7).orderBy("recency").collect():
        got.setdefault(r["question_id"], []).append((r["opened_on"], r["incident_id"]))
    rows = [(r["opened_on"], r["incident_id"], r["kind"]) for r in profile.collect()]
    held = {k: [r[:2] for r in rows if r[2] == k] for k in "ab"} | {"*": [r[:2] for r in rows]}
    assert got == _recent_by_hand([(q, c) for q, kinds in named for c in (kinds or ["*"])], held, 7)


def test_recent_rows_are_not_made_or_sorted_in_one_task(frame, monkeypatch):
    """Each question's rows come from the ranked list of its selection, over tasks of bounded size."""
    monkeypatch.setattr(fp_model, "TASK_ROWS", 100)
    profile = frame([(i, "2024-01-01", "a", "Low", "T1", "prod", "Yes") for i in range(20)],
                    "incident_id long, opened_on string, kind string, severity string, technique string, environment string, internet_exposed string")
    filters = frame([(q, ["a"], [], [], [], False) for q in range(300)],
                    "question_id long, kind array<string>, severity array<string>, environment array<string>, technique array<string>, exposed_only boolean")
    recent = fp_model.select_recent(filters, profile, 20)
    assert recent.count() == 6000
    assert recent.rdd.getNumPartitions() == 60
    assert max(len(p) for p in recent.rdd.glom().collect()) <= 400
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_best_model(frame):
    m = frame([("b", 80.0, 1.0), ("a", 80.0, 2.0), ("c", 79.0, 3.0)], "model string, auc double, f1 double")
    assert fp_model.best_model(m).first()["model"] == "a"


@pytest.mark.parametrize("model", ["logistic", "boosting"])
def test_kdd_with_unseen_service(spark, tmp_path, model):
    rnd = random.Random(1)

    def line(service, attack):
        numbers = [str(rnd.random() + (2 if attack and i % 3 == 0 else 0)) for i in range(38)]
        return ",".join([numbers[0], "tcp", service, "SF", *numbers[1:], "neptune" if attack else "normal", "15"])

    train = [line(rnd.choice(["http", "ftp"]), i % 2) for i in range(60)]
    test = [line(rnd.choice(["http", "new"]), i % 2) for i in range(20)]
    (tmp_path / "train.txt").write_text("\n".join(train))
    (tmp_path / "test.txt").write_text("\n".join(test))
    a, b = (kdd.read_kdd(spark, str(tmp_path / n)) for n in ("train.txt", "test.txt"))
    assert a.where("attack = 1").count() == 30 and len(a.columns) == 44
    row = intrusion.evaluate_kdd(intrusion.fit_kdd(a, model, trees=3), a, b, model).first()
    assert row["n_train"] == 60 and row["n_test"] == 20 and row["accuracy"] > 80
    assert row["train_attack_pct"] == 50.0


def test_exported_model_scores_like_the_fitted_one(spark, labelled, tmp_path):
    # unknown assets: categories without a value
    rows = labelled.withColumn("os", F.when(F.col("incident_id") % 9 != 0, F.col("os")))
    fitted = fp_model.fit_fp(rows)
    model = fp_model.LinearModel.of(fitted)
    fp_model.save_model(model, rows.agg(F.count("*").alias("n")), str(tmp_path))
    again = fp_model.load_model(spark, str(tmp_path))
    assert sorted(again.rows, key=str) == sorted(model.rows, key=str)
    odd = rows.limit(50).withColumns({"kind": F.lit("Never Seen"), "environment": F.lit(None).cast("string")})
    for df in (rows, odd):
        both = fp_model.probability(fitted.transform(df)).select("incident_id", F.col("p").alias("a")).join(
            again.transform(df).select("incident_id", F.col("p").alias("b")), "incident_id")
        assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9
    assert fp_model.fit_gaps(rows, again).agg(F.max(F.abs("slope"))).first()[0] < 5e-4


def test_auc_with_ties(frame, monkeypatch):
    from wardlight.plans import ordering

    rnd = random.Random(4)
    rows = [(rnd.randrange(2), rnd.randrange(12) / 10) for _ in range(300)]
    yes, no = ([p for y, p in rows if y == k] for k in (1, 0))
    expected = 100 * sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    df = frame(rows, "label int, p double")
    assert fp_model.auc(df) == round(expected, 1)
    monkeypatch.setattr(ordering, "GROUP_ROWS", 3)  # scores in several ranges
    assert fp_model.auc(df) == round(expected, 1)
    assert fp_model.auc(df.where("label = 1")) is None


def test_fits_read_cells_instead_of_rows(spark):
    """A hundred times the rows are the same cells, and the weighted fit is at the rows' optimum."""
    few = [("a" if i % 3 else "b", "t", "e" if i % 2 else None, "c", "o", "Yes", i % 4, int(i % 5 == 0), i) for i in range(60)]
    names = ", ".join(f"{c} string" for c in fp_model.CATEGORIES)
    rows = spark.createDataFrame(few, f"{names}, severity_level int, label int, incident_id long")
    many = rows.crossJoin(spark.range(100).withColumnRenamed("id", "again"))
    cells = fp_model.fitting_cells(many)
    assert cells.count() == fp_model.fitting_cells(rows).count() <= 60
    assert cells.agg({fp_model.CELL_ROWS: "sum"}).first()[0] == 6000
    gaps = fp_model.fit_gaps(many, fp_model.LinearModel.of(fp_model.fit_fp(many))).collect()
    assert gaps and all(abs(g["slope"]) < 1e-4 for g in gaps)


def _records(spark, n, parts=1):
    """Connection records: three numbers differ, one does not follow the label, the others are constant."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        a, b = rnd.gauss(0, 2), rnd.random() * 1e6
        attack = int(a + b / 1e6 + rnd.gauss(0, 1) + (i % 3 == 0) > 1)
        rows.append((*([a, b, a + 1e-3 * b] + [7.0] * (len(kdd.NUMBERS) - 3)), "tcp", "http" if i % 3 else "ftp", None if i % 50 == 0 else "SF", attack))
    ddl = ", ".join([f"{c} double" for c in kdd.NUMBERS] + [f"{c} string" for c in kdd.CATEGORIES] + ["attack int"])
    return spark.createDataFrame(rows, ddl).coalesce(1).repartition(parts)


@pytest.mark.parametrize("start", [1_000_000, 100])
def test_kdd_logistic_is_at_its_optimum_over_all_rows(spark, monkeypatch, start):
    """Newton's steps hold a few sums, no copy of the rows, and end where the penalised loss has no slope."""
    monkeypatch.setattr(intrusion, "START_ROWS", start)
    monkeypatch.setattr(intrusion, "START_SHARE", 4)
    rows = _records(spark, 2000, 3)
    model = intrusion.fit_kdd(rows, "logistic")
    assert isinstance(model, fp_model.LinearModel)
    kept = [c for c in kdd.NUMBERS[:3]]
    got = model.transform(rows).select(*kept, *kdd.CATEGORIES, "attack", "p").collect()
    weight = {(f, v): w for f, v, w in model.rows}
    gap = [r["p"] - r["attack"] for r in got]
    assert abs(sum(gap)) < 1e-3
    for c in kept:
        mean = sum(r[c] for r in got) / len(got)
        scale = (sum((r[c] - mean) ** 2 for r in got) / (len(got) - 1)) ** 0.5
        assert abs(sum(g * (r[c] - mean) / scale for g, r in zip(gap, got)) + weight[c, None] * scale) < 1e-3
    for c, v in (("service", "ftp"), ("service", "http"), ("flag", "SF"), ("flag", None)):
        assert abs(sum(g for g, r in zip(gap, got) if r[c] == v) + weight[c, v]) < 1e-3
    assert all(weight[c, None] == 0 for c in kdd.NUMBERS[3:])  # constant ones


def test_kdd_logistic_of_one_class_and_of_bad_numbers(spark):
    rows = _records(spark, 60)
    train = rows.where("attack = 0")
    row = intrusion.evaluate_kdd(intrusion.fit_kdd(train, "logistic"), train, rows, "logistic").first()
    assert row["recall"] == 0.0 and row["train_attack_pct"] == 0.0
    model = intrusion.fit_kdd(rows, "logistic")
    for bad in (None, float("nan")):
        odd = rows.withColumn("hot", F.lit(bad).cast("double"))
        with pytest.raises(Exception, match="null or not a number"):
            intrusion.fit_kdd(odd, "logistic")
        with pytest.raises(Exception, match="null or not a number"):
            intrusion.evaluate_kdd(model, rows, odd, "logistic")


def test_kdd_scores_rows_once(spark, frame):
    scored = spark.sparkContext.accumulator(0)

    def score(v):
        scored.add(1)
        return float(v)

    pred = frame([(i % 2, float(i % 2), i % 7) for i in range(70)], "attack int, prediction double, v int")
    pred = pred.withColumn("p", F.udf(score, "double")("v"))
    row = intrusion.measured_kdd(pred, pred, "boosting").first()
    assert row["n_test"] == 70 and row["accuracy"] == 100.0
    assert scored.value == 70


def test_boosting_reads_rows_from_all_cores(spark, monkeypatch):
    """Rows that few tasks read are dealt out before trees are grown; even ones stay where they are."""
    rows = _records(spark, 400)
    assert intrusion.dealt(rows) is rows
    monkeypatch.setattr(intrusion, "LEAST_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    dealt = intrusion.dealt(rows)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == cores and max(sizes) <= 1.25 * 400 / cores
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    even = rows.repartition(2 * cores)
    assert intrusion.dealt(even) is even
    seen = []
    monkeypatch.setattr(intrusion, "dealt", lambda df, real=intrusion.dealt: seen.append(real(df)) or seen[-1])
    intrusion.fit_kdd(rows, "boosting", trees=2)
    assert [df.rdd.getNumPartitions() for df in seen] == [cores]


def _spark_trees(rows, trees):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=[*kdd.NUMBERS, *intrusion.HOT], outputCol="features"),
        GBTClassifier(labelCol="attack", maxIter=trees, maxDepth=5, seed=fp_model.SEED),
    ]
    return Pipeline(stages=[*intrusion._one_hot(), *stages]).fit(rows)


def _trial_records(spark, n, seed):
    """Labels that hang on numbers and categories, with ties, zeros, a constant column and null categories."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        numbers = [rnd.choice([0, 0, 1, 2, 5]) if k % 4 else rnd.random() * (k + 1) for k in range(len(kdd.NUMBERS) - 1)] + [3]
        kinds = [rnd.choice(["tcp", "udp"]), rnd.choice(["http", "ftp", "smtp", None]), rnd.choice(["SF", "S0"])]
        odds = 0.1 + 0.5 * (numbers[0] > 0.6) + 0.3 * (kinds[1] == "ftp" and numbers[1] < 2)
        rows.append((*map(float, numbers), *kinds, int(rnd.random() < odds)))
    ddl = ", ".join([*(f"`{c}` double" for c in kdd.NUMBERS), *(f"{c} string" for c in kdd.CATEGORIES), "attack int"])
    return spark.createDataFrame(rows, ddl).repartition(3).cache()


@pytest.mark.parametrize("n", [4_000, 11_000])
def test_boosted_trees_are_sparks(spark, n):
    """The same scores as Spark's trees, also for values the fit did not see; from 10,000 rows on with sampled thresholds.
    Two splits may part a node's rows alike, and rounding decides which one other rows meet."""
    rows, other = _trial_records(spark, n, 5), _trial_records(spark, 300, 6)
    other = other.withColumn("service", F.when(F.col("src_bytes") < 1, F.lit("new")).otherwise(F.col("service")))
    fitted, plain = intrusion.fit_kdd(rows, "boosting", trees=4), _spark_trees(rows, 4)
    assert not hasattr(fitted, "stages")
    for data, share in ((rows, 1), (other, 0.98)):
        expected = [(r["attack"], r["p"], r["prediction"]) for r in fp_model.scored_by(plain, data).collect()]
        got = [(r["attack"], r["p"], r["prediction"]) for r in fitted.transform(data).collect()]
        same = [a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, expected)]
        assert len(got) == len(expected) and sum(same) >= share * len(same)


def test_boosting_of_one_class_and_of_bad_numbers(spark):
    rows = _trial_records(spark, 60, 7)
    train = rows.where("attack = 0")
    row = intrusion.evaluate_kdd(intrusion.fit_kdd(train, "boosting", trees=3), train, rows, "boosting").first()
    assert row["recall"] == 0.0 and row["train_attack_pct"] == 0.0
    model = intrusion.fit_kdd(rows, "boosting", trees=2)
    for bad in (None, float("nan")):
        odd = rows.withColumn("hot", F.lit(bad).cast("double"))
        with pytest.raises(Exception, match="null or not a number"):
            intrusion.fit_kdd(odd, "boosting", trees=2)
        with pytest.raises(Exception, match="null or not a number"):
            intrusion.evaluate_kdd(model, rows, odd, "boosting").first()


def test_boosting_keeps_scores_across_written_ones(spark, monkeypatch):
    """Scores that were written and read again are the same; no scores or blocks stay held."""
    from wardlight.operators import boosting

    rows, held = _trial_records(spark, 300, 8), spark.sparkContext._jsc.getPersistentRDDs().size()
    expected = [r["p"] for r in intrusion.fit_kdd(rows, "boosting", trees=6).transform(rows).collect()]
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    got = [r["p"] for r in intrusion.fit_kdd(rows, "boosting", trees=6).transform(rows).collect()]
    assert got == pytest.approx(expected, abs=1e-12)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
