"""Classification metrics as aggregations.

Binary labels {0, 1}.  Every metric is derived from four conditional sums
(tp, fp, fn, tn), computed in one grouped pass with map-side partial
aggregation, so a metric over billions of rows moves one small row per
partition and group through the shuffle.  Ratios are formed from exact
integer counts, so results do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.scoring import apply_threshold, softmax2

# Fixed values of the reference: the 41-point threshold grid is
# numpy.arange(0.10, 0.91, 0.02) (element 20 is 0.5000000000000001), the
# default threshold is 0.5, and the confidence multiplier is 1.96.
THRESHOLDS = [float(t) for t in np.arange(0.10, 0.91, 0.02)]
DEFAULT_THRESHOLD = 0.5
Z_95 = 1.96

AUC_BUCKETS = 256


def _sum_if(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, tp, fp, fn, tn) in one aggregation pass."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _sum_if((y == 1) & (p == 1)).alias("tp"),
        _sum_if((y == 0) & (p == 1)).alias("fp"),
        _sum_if((y == 1) & (p == 0)).alias("fn"),
        _sum_if((y == 0) & (p == 0)).alias("tn"),
    )


def _ratio(num: Column, den: Column) -> Column:
    """num/den as double, 0 when den is 0 (the zero-division rule)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def f1_pos_col(tp="tp", fp="fp", fn="fn") -> Column:
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def f1_neg_col(tn="tn", fp="fp", fn="fn") -> Column:
    tn, fp, fn = F.col(tn), F.col(fp), F.col(fn)
    return _ratio(2 * tn, 2 * tn + fp + fn)


def f1_macro_col() -> Column:
    """Mean F1 over the classes present in truth or prediction."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos_seen = (tp + fn + fp > 0).cast("int")
    neg_seen = (tn + fp + fn > 0).cast("int")
    num = f1_pos_col() * pos_seen + f1_neg_col() * neg_seen
    return F.when(pos_seen + neg_seen > 0, num / (pos_seen + neg_seen)).otherwise(F.lit(0.0))


def f1_weighted_col() -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    num = (tp + fn).cast("double") * f1_pos_col() + (tn + fp).cast("double") * f1_neg_col()
    return F.when(n > 0, num / n.cast("double")).otherwise(F.lit(0.0))


def accuracy_col() -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _ratio(tp + tn, tp + fp + fn + tn)


def with_f1_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, f1_macro, f1_weighted, f1_mani to a confusion-count table."""
    return counts.select(
        "*",
        accuracy_col().alias("accuracy"),
        f1_macro_col().alias("f1_macro"),
        f1_weighted_col().alias("f1_weighted"),
        f1_pos_col().alias("f1_mani"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, prediction, n): always the full 2x2, zero cells included."""
    c = confusion_counts(df, label, prediction, by)
    return c.select(*by, F.inline(F.array(
        F.struct(F.lit(0).alias("label"), F.lit(0).alias("prediction"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("label"), F.lit(1).alias("prediction"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(0).alias("prediction"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(1).alias("prediction"), F.col("tp").alias("n")),
    )))


def confusion_array(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    """Nested matrix, rows = true, columns = predicted, labels ascending."""
    return F.array(F.array(F.col(tn), F.col(fp)), F.array(F.col(fn), F.col(tp)))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: Sequence[str] = (), names=("NO_MANI", "MANI")) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    c = confusion_counts(df, label, prediction, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = f1_pos_col(), f1_neg_col()
    s1, s0 = (tp + fn), (tn + fp)
    n = tp + fp + fn + tn
    nd = n.cast("double")
    acc = accuracy_col()

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    def wavg(a, b):
        return F.when(n > 0, (s0.cast("double") * a + s1.cast("double") * b) / nd).otherwise(F.lit(0.0))

    return c.select(*by, F.inline(F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            by: Sequence[str] = (), buckets: int = AUC_BUCKETS) -> DataFrame:
    """(by..., n_pos, n_neg, roc_auc): Mann-Whitney AUC, ties count half.

    Rows are first collapsed to distinct (group, score) pairs (partial
    aggregation absorbs hot scores).  The count of negatives below each score
    is a prefix sum, computed in two levels so no task sees a whole group:
    quantile buckets of the distinct scores (bounds from a mergeable sketch),
    exact offsets per bucket from a table of at most groups x (buckets + 1)
    rows, then a running sum inside each bucket.  AUC is an exact integer
    ratio; NULL when a class is missing.
    """
    by = list(by)
    y = F.col(label)
    d = df.groupBy(*by, F.col(score).alias("_s")).agg(
        _sum_if(y == 1).alias("_pos"), _sum_if(y == 0).alias("_neg"))
    fracs = [i / buckets for i in range(1, buckets)]
    sketch = d.groupBy(*by).agg(F.percentile_approx("_s", fracs, 10000).alias("_bounds"))
    if by:
        d = d.join(sketch, by)
    else:
        d = d.withColumn("_bounds", sketch.select("_bounds").scalar())
    d = d.withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_s")))).drop("_bounds")
    tot = d.groupBy(*by, "_b").agg(F.sum("_neg").alias("_bneg"))
    w_off = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*by, "_b", F.coalesce(F.sum("_bneg").over(w_off), F.lit(0)).alias("_off"))
    d = d.join(tot, by + ["_b"])
    w_in = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_off") + F.coalesce(F.sum("_neg").over(w_in), F.lit(0))
    d = d.select(*by, "_pos", "_neg", (F.col("_pos") * (2 * below + F.col("_neg"))).alias("_u2"))
    g = d.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
                           F.sum("_u2").alias("_u2"))
    den = 2 * F.col("n_pos") * F.col("n_neg")
    return g.select(*by, "n_pos", "n_neg",
                    F.when(den > 0, F.col("_u2").cast("double") / den.cast("double")).alias("roc_auc"))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction",
             score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One metric row per group: counts, accuracy, F1 variants, the nested confusion matrix
    (rows = true class, columns = predicted) and ROC-AUC.

    ``roc_auc`` is NULL when no score column is given (a model without
    probabilities) or a class is absent.
    """
    by = list(by)
    m = with_f1_metrics(confusion_counts(df, label, prediction, by)).withColumn("confusion_matrix", confusion_array())
    if score is None:
        return m.withColumn("roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(df, label, score, by).select(*by, "roc_auc")
    if by:
        return m.join(auc, by, "left")
    return m.withColumn("roc_auc", auc.select("roc_auc").scalar())


def split_distribution(df: DataFrame, split: str = "data_type", label: str = "label") -> DataFrame:
    """(split, n_rows, n_pos, n_neg, pos_pct) per split."""
    y = F.col(label)
    return df.groupBy(F.col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _sum_if(y == 1).alias("n_pos"),
        _sum_if(y == 0).alias("n_neg"),
        (F.avg(y.cast("double")) * 100.0).alias("pos_pct"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): total / (classes present x count).

    Null labels are not a class but count in the total.  The class table is
    tiny, so the totals are window aggregates over it.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    classes = F.sum(F.col("label").isNotNull().cast("long")).over(w)
    return counts.select("label", "n", (total.cast("double") / (classes * F.col("n"))).alias("weight")) \
        .filter(F.col("label").isNotNull())


def class_weights_binary(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) for classes 0 and 1: n_total / (2 x count), NULL for an absent class."""
    y = F.col(label)
    c = df.agg(F.count(F.lit(1)).alias("total"), _sum_if(y == 0).alias("n0"), _sum_if(y == 1).alias("n1"))
    return c.select(F.inline(F.array(
        F.struct(F.lit(0).alias("label"), F.col("n0").alias("n"),
                 F.when(F.col("n0") > 0, F.col("total") / (2.0 * F.col("n0"))).alias("weight")),
        F.struct(F.lit(1).alias("label"), F.col("n1").alias("n"),
                 F.when(F.col("n1") > 0, F.col("total") / (2.0 * F.col("n1"))).alias("weight")),
    )))


def score_summary(df: DataFrame, value: str = "f1_macro", by: Sequence[str] = (),
                  z: float = Z_95) -> DataFrame:
    """n, mean, population std, standard error and the normal 95% interval."""
    g = df.groupBy(*by).agg(F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"),
                            F.stddev_pop(value).alias("std"))
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    return g.select(*by, "n", "mean", "std", se.alias("se"),
                    (F.col("mean") - F.lit(z) * se).alias("ci_lower"),
                    (F.col("mean") + F.lit(z) * se).alias("ci_upper"))


def ci_verdict(summary: DataFrame, baseline: Column) -> DataFrame:
    """Is the baseline outside [ci_lower, ci_upper]?"""
    return summary.select("*", baseline.alias("baseline"),
                          ((baseline < F.col("ci_lower")) | (baseline > F.col("ci_upper")))
                          .alias("outside_ci"))


def shift_verdict(summary: DataFrame, baseline: Column) -> DataFrame:
    """diff = mean - baseline; the half-width is z x se; two- and one-sided tests."""
    half = F.col("mean") - F.col("ci_lower")
    diff = F.col("mean") - baseline
    return summary.select("*", baseline.alias("baseline"), diff.alias("diff"),
                          half.alias("ci_half_width"),
                          (F.abs(diff) > half).alias("significant"),
                          (diff > half).alias("significant_gain"))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """(by..., t_idx, threshold, tp, fp, fn, tn, f1_macro) for every grid point.

    Scores are bucketed by how many grid points lie below them (pred = 1 at
    threshold i iff bucket > i), so the data is read once and reduced to at
    most groups x (len(grid) + 1) rows; the per-threshold counts are suffix
    sums over that small table.
    """
    by = list(by)
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    y = F.col(label)
    b = df.select(*by, y.alias("_y"),
                  F.size(F.filter(grid, lambda t: t < F.col(score))).alias("_b"))
    cnt = b.groupBy(*by, "_b").agg(_sum_if(F.col("_y") == 1).alias("_p"),
                                   _sum_if(F.col("_y") == 0).alias("_q"))
    pts = cnt.select(*by, "_b", "_p", "_q", F.posexplode(grid).alias("t_idx", "threshold"))
    above = F.col("_b") > F.col("t_idx")
    s = pts.groupBy(*by, "t_idx", "threshold").agg(
        F.sum(F.when(above, F.col("_p")).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(above, F.col("_q")).otherwise(F.lit(0))).alias("fp"),
        F.sum("_p").alias("_P"), F.sum("_q").alias("_Q"))
    s = s.select(*by, "t_idx", "threshold", "tp", "fp",
                 (F.col("_P") - F.col("tp")).alias("fn"), (F.col("_Q") - F.col("fp")).alias("tn"))
    return s.select("*", f1_macro_col().alias("f1_macro"))


def calibrated_threshold(sweep: DataFrame, by: Sequence[str] = (),
                         default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Best grid point (lowest on ties) and the F1 at the point nearest ``default``."""
    by = list(by)
    best = F.min_by(F.struct("threshold", "f1_macro"),
                    F.struct((-F.col("f1_macro")).alias("a"), F.col("t_idx").alias("b")))
    near = F.min_by(F.col("f1_macro"),
                    F.struct(F.abs(F.col("threshold") - F.lit(default)).alias("a"),
                             F.col("t_idx").alias("b")))
    g = sweep.groupBy(*by).agg(best.alias("_best"), near.alias("default_f1"))
    return g.select(*by, F.col("_best.threshold").alias("calibrated_threshold"),
                    F.col("_best.f1_macro").alias("calibrated_f1"), "default_f1")


def evaluate_logits(df: DataFrame, logits: str = "logits", label: str = "label",
                    by: Sequence[str] = ()) -> DataFrame:
    """The fine-tuning metric callback: two-class logits -> argmax prediction
    (ties -> class 0) and softmax P(class 1) -> the A11 metric row.  As in that
    callback, an AUC that cannot be computed (one class) is 0.0, not NULL."""
    _, p1, best = softmax2(logits)
    d = df.select(*by, F.col(label).alias("label"), best.alias("prediction"), p1.alias("prob_mani"))
    e = evaluate(d, score="prob_mani", by=by)
    return e.withColumn("roc_auc", F.coalesce("roc_auc", F.lit(0.0)))
