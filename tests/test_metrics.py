"""Metric golden vectors (FIXTURES 3.1) and properties."""

import pytest
from pyspark.sql import functions as F

from claimlens.operators import metrics as M


def rows_from_confusion(cm):
    (tn, fp), (fn, tp) = cm
    return [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp


GOLDEN = [
    ([[33, 56], [8, 53]], 0.5733, 0.5656, 0.5548, 0.6235),
    ([[30, 59], [3, 58]], 0.5867, 0.5717, 0.5568, 0.6517),
    ([[29, 60], [4, 57]], 0.5733, 0.5579, 0.5425, 0.6404),
    ([[89, 0], [61, 0]], 0.5933, 0.3724, 0.4419, 0.0),
    ([[0, 50], [0, 100]], 0.6667, 0.4, 0.5333, 0.8),
]


@pytest.mark.parametrize("cm,acc,f1m,f1w,f1p", GOLDEN)
def test_golden_confusions(spark, cm, acc, f1m, f1w, f1p):
    df = spark.createDataFrame(rows_from_confusion(cm), "label int, prediction int")
    r = M.evaluate(df).first()
    assert [[r["tn"], r["fp"]], [r["fn"], r["tp"]]] == cm
    assert round(r["accuracy"], 4) == acc
    assert round(r["f1_macro"], 4) == f1m
    assert round(r["f1_weighted"], 4) == f1w
    assert round(r["f1_mani"], 4) == f1p
    assert r["roc_auc"] is None


def test_one_class_macro_is_one(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "label int, prediction int")
    r = M.evaluate(df).first()
    assert r["f1_macro"] == 1.0
    cm = M.confusion_matrix(df).orderBy("label", "prediction").collect()
    assert [x["n"] for x in cm] == [0, 0, 0, 5]


def test_auc_with_ties(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1, 1], [0.1, 0.4, 0.4, 0.8, 0.8, 0.2])), "label int, score double")
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(0.8125)
    neg = df.withColumn("score", -F.col("score"))
    assert M.roc_auc(neg).first()["roc_auc"] == pytest.approx(1 - 0.8125)


def test_auc_bucketed_equals_plain(spark):
    import random
    rnd = random.Random(7)
    data = [(rnd.randint(0, 1), float(rnd.randint(0, 300)) / 7.0) for _ in range(3000)]
    df = spark.createDataFrame(data, "label int, score double")
    pos = [s for y, s in data if y == 1]
    negs = [s for y, s in data if y == 0]
    u = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in negs)
    assert M.roc_auc(df, buckets=16).first()["roc_auc"] == pytest.approx(u / (len(pos) * len(negs)), abs=1e-12)


def test_auc_missing_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "label int, score double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_threshold_grid():
    assert len(M.THRESHOLDS) == 41
    assert M.THRESHOLDS[20] == 0.5000000000000001
    assert M.THRESHOLDS[0] == 0.1


def test_threshold_sweep_matches_direct(spark):
    import random
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), rnd.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "label int, score double")
    sweep = {r["t_idx"]: r for r in M.threshold_sweep(df).collect()}
    for i, t in enumerate(M.THRESHOLDS):
        tp = sum(1 for y, s in data if y == 1 and s > t)
        fp = sum(1 for y, s in data if y == 0 and s > t)
        assert (sweep[i]["tp"], sweep[i]["fp"]) == (tp, fp)
    # predicted positives never grow with the threshold
    pp = [sweep[i]["tp"] + sweep[i]["fp"] for i in range(41)]
    assert pp == sorted(pp, reverse=True)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] + [(None,)], "label int")
    w = {r["label"]: r["weight"] for r in M.class_weights(df).collect()}
    assert w == {1: pytest.approx(5 / (2 * 3)), 0: pytest.approx(5 / 2)}
    wb = {r["label"]: r["weight"] for r in M.class_weights_binary(df.filter("label is not null")).collect()}
    assert wb == {1: pytest.approx(4 / 6), 0: pytest.approx(2.0)}


def test_score_summary_and_verdicts(spark):
    vals = [0.5, 0.6, 0.7, 0.8]
    df = spark.createDataFrame([(v,) for v in vals], "f1_macro double")
    s = M.score_summary(df)
    r = s.first()
    import statistics
    sd = statistics.pstdev(vals)
    assert r["n"] == 4 and r["mean"] == pytest.approx(0.65) and r["std"] == pytest.approx(sd)
    assert r["ci_lower"] == pytest.approx(0.65 - 1.96 * sd / 2)
    v = M.ci_verdict(s, F.lit(0.2)).first()
    assert v["outside_ci"] is True
    sv = M.shift_verdict(s, F.lit(0.64)).first()
    assert sv["significant"] is False and sv["diff"] == pytest.approx(0.01)


def test_classification_report(spark):
    df = spark.createDataFrame(rows_from_confusion([[30, 59], [3, 58]]), "label int, prediction int")
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["MANI"]["support"] == 61 and rep["NO_MANI"]["support"] == 89
    assert round(rep["macro avg"]["f1"], 4) == 0.5717
    assert round(rep["weighted avg"]["f1"], 4) == 0.5568


def test_evaluate_logits(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1), ([1.0, 0.0], 0), ([0.5, 0.5], 1), ([0.0, 2.0], 0)],
                               "logits array<double>, label int")
    r = M.evaluate_logits(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)     # tie goes to class 0
    one = spark.createDataFrame([([0.0, 1.0], 1)], "logits array<double>, label int")
    assert M.evaluate_logits(one).first()["roc_auc"] == 0.0


def test_class_weights_binary_with_one_class(spark):
    df = spark.createDataFrame([(1,), (1,)], "label int")
    got = {r["label"]: r["weight"] for r in M.class_weights_binary(df).collect()}
    assert got == {0: None, 1: 0.5}


def test_evaluate_has_the_nested_matrix(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "label int, prediction int")
    assert M.evaluate(df).first()["confusion_matrix"] == [[2, 1], [1, 1]]
