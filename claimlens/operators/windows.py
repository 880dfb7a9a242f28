"""Running (cumulative) aggregates without a single-task window.

A plain ``Window.partitionBy(group).orderBy(x)`` running sum puts a whole
group into one task.  ``running_sums`` splits each group into quantile
ranges of the order column (bounds from a mergeable sketch), sums each range
(a table of at most groups x buckets rows), turns those sums into exact
offsets, and finishes with a running window inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def running_sums(df: DataFrame, order_col: str, sums: dict[str, Column], by: Sequence[str] = (),
                 buckets: int = BUCKETS) -> DataFrame:
    """Adds one inclusive running-sum column per entry of ``sums``, ordered by
    ``order_col`` (unique within a group) inside each ``by`` group."""
    by = list(by)
    names = list(sums)
    d = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    fr = [i / buckets for i in range(1, buckets)]
    sk = d.groupBy(*by).agg(F.percentile_approx(order_col, fr, 10000).alias("_bounds"))
    d = d.join(sk, by) if by else d.withColumn("_bounds", sk.select("_bounds").scalar())
    d = d.withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col(order_col)))).drop("_bounds")
    tot = d.groupBy(*by, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    w_off = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(w_off), F.lit(0)).alias(f"_o_{n}")
                                  for n in names])
    d = d.join(F.broadcast(tot), by + ["_b"])  # bounded: groups x buckets rows
    w_in = Window.partitionBy(*by, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = d.select(*df.columns, *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w_in)).alias(n) for n in names])
    return out


def running_f1(df: DataFrame, order_col: str = "idx", by: Sequence[str] = ("strategy",),
               label: str = "label", prediction: str = "prediction", every: int = 10) -> DataFrame:
    """(by..., n, f1_macro): F1-macro of all predictions so far, reported after
    every ``every``-th prediction of each group."""
    from claimlens.operators.metrics import f1_macro_col
    y, p = F.col(label), F.col(prediction)
    r = running_sums(df, order_col, {
        "n": F.lit(1).cast("long"),
        "tp": ((y == 1) & (p == 1)).cast("long"), "fp": ((y == 0) & (p == 1)).cast("long"),
        "fn": ((y == 1) & (p == 0)).cast("long"), "tn": ((y == 0) & (p == 0)).cast("long"),
    }, by)
    return r.filter(F.col("n") % every == 0).select(*by, "n", f1_macro_col().alias("f1_macro"))


def running_mean(scores: DataFrame, value: str = "f1_macro", order: Sequence[str] = ("seed", "fold"),
                 report_by: str = "seed") -> DataFrame:
    """Mean of all scores so far, one row per ``report_by`` value (its last row).

    Input is one row per fit run (tens of rows), so a plain window is bounded."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(report_by).orderBy(*[F.desc(c) for c in order])
    r = scores.select(*order, F.avg(value).over(w).alias("running_mean"),
                      F.count(F.lit(1)).over(w).alias("runs_done"),
                      F.row_number().over(last).alias("_r"))
    return r.filter(F.col("_r") == 1).select(report_by, "runs_done", "running_mean")
