"""Deterministic stratified folds, holdouts and samples.

A NumPy random stream cannot be reproduced on a cluster, so the random order
inside a class is replaced by ``md5(seed || ':' || row_id)`` (ties by row_id).
Allocation *counts* follow the reference's rules exactly.

Ranking inside a class without a single-task bottleneck: rows are bucketed by
the first ``prefix_len`` hex digits of their hash (16**prefix_len buckets per
class for hexadecimal keys, order-preserving).  Bucket sizes give exact offsets (a table of at
most groups x classes x buckets rows, broadcast); ``row_number`` then runs
inside each bucket, so a class holding a third of all rows is still ranked
by thousands of tasks in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_LEN = 3


def order_key(seed, id_col: str = "row_id", salt: str = "") -> Column:
    """md5 of '<seed>:<salt><row_id>' as lowercase hex."""
    s = F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))
    return F.md5(F.concat(s, F.lit(":" + salt), F.col(id_col).cast("string")))


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """label -> count: one small aggregate (bounded by the number of classes)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def ranked(df: DataFrame, key: Column, label: str = "label", by: Sequence[str] = (),
           id_col: str = "row_id", prefix_len: int = PREFIX_LEN) -> DataFrame:
    """Adds ``_pos``: 0-based position of the row when the rows of each ``by``
    group are laid out by (label, key, id).  ``_rank`` is the rank inside the class."""
    by = list(by)
    d = df.withColumn("_h", key).withColumn("_bk", F.substring("_h", 1, prefix_len))
    cnt = d.groupBy(*by, label, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w_pos = Window.partitionBy(*by).orderBy(label, "_bk").rowsBetween(Window.unboundedPreceding, -1)
    w_cls = Window.partitionBy(*by, label).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*by, label, "_bk",
                     F.coalesce(F.sum("_n").over(w_pos), F.lit(0)).alias("_off_pos"),
                     F.coalesce(F.sum("_n").over(w_cls), F.lit(0)).alias("_off_cls"))
    # bounded: groups x classes x 16**prefix_len rows
    d = d.join(F.broadcast(off), [*by, label, "_bk"])
    rn = F.row_number().over(Window.partitionBy(*by, label, "_bk").orderBy("_h", id_col)) - 1
    return d.withColumn("_rn", rn).select(
        *[c for c in df.columns],
        (F.col("_off_pos") + F.col("_rn")).alias("_pos"),
        (F.col("_off_cls") + F.col("_rn")).alias("_rank"))


def _check_folds(counts: dict, k: int):
    if k < 2:
        raise ValueError("k must be at least 2")
    if all(v < k for v in counts.values()):
        raise ValueError(f"Cannot have number of splits k={k} greater than the number of rows of every class")


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label",
                     id_col: str = "row_id") -> DataFrame:
    """(row_id, label, fold): rows laid out by class, position p -> fold p mod k.
    Per-fold class counts differ by at most one and fold sizes balance."""
    _check_folds(class_counts(df, label), k)
    r = ranked(df.select(id_col, label), order_key(seed, id_col), label, (), id_col)
    return r.select(id_col, label, (F.col("_pos") % k).cast("int").alias("fold"))


def repeated_stratified_kfold(df: DataFrame, seeds: Sequence[int] = range(10), k: int = 5,
                              label: str = "label", id_col: str = "row_id") -> DataFrame:
    """(seed, row_id, label, fold) for every seed: one pass, the seed is a group key."""
    _check_folds(class_counts(df, label), k)
    d = df.select(id_col, label, F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    r = ranked(d, order_key("seed", id_col), label, ["seed"], id_col)
    return r.select("seed", id_col, label, (F.col("_pos") % k).cast("int").alias("fold"))


def holdout_quotas(counts: dict, test_size) -> dict:
    """Per-class TRAIN quota: floor(n_train x n_c / n) plus one for the classes
    with the largest remainders (ties -> lower class), computed exactly."""
    n = sum(counts.values())
    n_test = int(test_size) if isinstance(test_size, int) else math.ceil(float(test_size) * n)
    n_train = n - n_test
    if min(counts.values()) < 2:
        raise ValueError("The least populated class in y has only 1 member, which is too few.")
    if n_test < len(counts) or n_train < len(counts):
        raise ValueError("test_size and train size must be at least the number of classes")
    floors = {c: (n_train * v) // n for c, v in counts.items()}
    rems = sorted(counts, key=lambda c: (-((n_train * counts[c]) % n), c))
    need = n_train - sum(floors.values())
    for c in rems[:need]:
        floors[c] += 1
    return floors


def stratified_holdout(df: DataFrame, test_size=150, seeds: Sequence[int] = (42,), label: str = "label",
                       id_col: str = "row_id") -> DataFrame:
    """(seed, row_id, label, role): exactly ``test_size`` test rows per seed
    (int = rows, float = fraction rounded up), per-class train quotas by
    largest remainder; the first ``quota`` rows of a class in hash order train."""
    quotas = holdout_quotas(class_counts(df, label), test_size)
    qmap = F.create_map(*[x for c, q in sorted(quotas.items()) for x in (F.lit(c), F.lit(q))])
    d = df.select(id_col, label, F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    r = ranked(d, order_key("seed", id_col), label, ["seed"], id_col)
    role = F.when(F.col("_rank") < F.element_at(qmap, F.col(label)), F.lit("train")).otherwise(F.lit("test"))
    return r.select("seed", id_col, label, role.alias("role"))


def few_shot_sample(df: DataFrame, k: int = 3, seed: int = 42, label: str = "label",
                    id_col: str = "row_id") -> DataFrame:
    """k//2 + k%2 positives and k//2 negatives, then shuffled -> ``position``.

    The rows are chosen on ids and labels alone, by one top-k per class (each
    partition keeps its k first); the k ids are then joined to their rows, so no text
    is sorted or moved."""
    quota = {1: k // 2 + k % 2, 0: k // 2}
    counts = class_counts(df, label)
    for c, q in quota.items():
        if counts.get(c, 0) < q:
            raise ValueError(f"class {c} has {counts.get(c, 0)} rows, {q} needed")
    ids = df.select(id_col, label)
    first = [ids.filter(F.col(label) == c).orderBy(order_key(seed, id_col), id_col).limit(q) for c, q in quota.items() if q]
    picked = first[0] if len(first) == 1 else first[0].union(first[1])
    pos = F.row_number().over(Window.orderBy(order_key(seed, id_col, "shuffle:"), id_col))   # k rows
    chosen = picked.select(F.col(id_col).alias("_id"), pos.cast("int").alias("position"))
    return df.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).drop("_id")


def select_fold(assign: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    return assign.filter(F.col(fold_col) != fold), assign.filter(F.col(fold_col) == fold)
