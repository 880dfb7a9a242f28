"""Scoring expressions: thresholds, logits, rounding, metric-key hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import NEGATIVE_STATUS, POSITIVE_STATUS


def apply_threshold(score: str = "score", t: float = 0.5) -> Column:
    """1 iff score > t."""
    return (F.col(score) > F.lit(float(t))).cast("int")


def softmax2(logits: str = "logits") -> tuple[Column, Column, Column]:
    """(P(class 0), P(class 1), argmax) of two-class logits: the maximum is subtracted
    first, and ties go to class 0."""
    l0, l1 = F.col(logits).getItem(0), F.col(logits).getItem(1)
    m = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - m), F.exp(l1 - m)
    return e0 / (e0 + e1), e1 / (e0 + e1), (l1 > l0).cast("int")


def score_logits(df: DataFrame, logits: str = "logits", digits: int | None = 4) -> DataFrame:
    """Two-class logits -> prediction name, confidence, P(MANI), P(NO_MANI)."""
    p0, p1, best = softmax2(logits)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.select(
        "*",
        F.when(best == 1, F.lit(POSITIVE_STATUS)).otherwise(F.lit(NEGATIVE_STATUS)).alias("prediction"),
        rnd(F.greatest(p0, p1)).alias("confidence"),
        rnd(p1).alias("prob_mani"),
        rnd(p0).alias("prob_no_mani"),
    )


def round_metrics(df: DataFrame, digits: int = 4, pct_digits: int = 1, threshold_digits: int = 2) -> DataFrame:
    """Round doubles for reporting: 4 dp, percentages 1 dp, thresholds 2 dp."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            d = pct_digits if f.name.endswith("_pct") else threshold_digits if "threshold" in f.name else digits
            out.append(F.round(F.col(f.name), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def drop_metric_keys(df: DataFrame, marker: str = "runtime") -> DataFrame:
    """Leave out timing columns (names containing ``marker``) before reporting."""
    return df.select(*[c for c in df.columns if marker not in c])
