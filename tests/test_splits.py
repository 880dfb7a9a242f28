"""Fold, holdout and sampling properties (FIXTURES 3.5)."""

import pytest
from pyspark.sql import functions as F

from claimlens.operators import splits as X
from claimlens.sources import tables as S
from tests.conftest import SF_ORACLE, SF_SMALL


def test_kfold_golden_counts(spark):
    c = S.claims(spark, SF_ORACLE)
    f = X.stratified_kfold(c, k=5, seed=42)
    cnt = {(r["label"], r["fold"]): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert [cnt[(0, i)] for i in range(5)] == [12, 12, 12, 11, 11]
    assert [cnt[(1, i)] for i in range(5)] == [68, 68, 68, 69, 68]
    assert f.count() == f.select("row_id").distinct().count() == 399


def test_repeated_kfold_properties(spark):
    c = S.claims(spark, SF_SMALL)
    f = X.repeated_stratified_kfold(c, seeds=[0, 1, 2], k=5)
    per = f.groupBy("seed", "row_id").count()
    assert per.filter("count != 1").count() == 0
    spread = f.groupBy("seed", "label", "fold").count().groupBy("seed", "label") \
        .agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.filter("d > 1").count() == 0
    # different seeds give different assignments
    a = {r["row_id"]: r["fold"] for r in f.filter("seed = 0").collect()}
    b = {r["row_id"]: r["fold"] for r in f.filter("seed = 1").collect()}
    assert a != b


def test_bucketed_rank_equals_plain_window(spark):
    from pyspark.sql import Window
    c = S.claims(spark, SF_ORACLE).select("row_id", "label")
    key = X.order_key(7)
    r = X.ranked(c, key, prefix_len=1).select("row_id", "_rank")
    plain = c.select("row_id", (F.row_number().over(Window.partitionBy("label").orderBy(key, "row_id")) - 1)
                     .alias("_rank"))
    assert sorted(r.collect()) == sorted(plain.collect())


def test_holdout_quotas_golden(spark):
    assert X.holdout_quotas({0: 58, 1: 341}, 150 / 800) == {0: 47, 1: 277}
    c = S.claims(spark, SF_ORACLE)
    h = X.stratified_holdout(c, 150 / 800, seeds=[0, 5])
    sizes = {(r["seed"], r["role"]): r["count"] for r in h.groupBy("seed", "role").count().collect()}
    assert sizes[(0, "test")] == sizes[(5, "test")] == 75


def test_holdout_errors():
    with pytest.raises(ValueError):
        X.holdout_quotas({0: 1, 1: 30}, 5)
    with pytest.raises(ValueError):
        X.holdout_quotas({0: 10, 1: 30}, 1)


def test_few_shot_sample(spark):
    tr = S.claims(spark, SF_ORACLE).filter("data_type = 'TRAIN'")
    ex = X.few_shot_sample(tr, k=5, seed=42).collect()
    assert len(ex) == 5
    assert sum(r["label"] for r in ex) == 3
    assert sorted(r["position"] for r in ex) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        X.few_shot_sample(tr.filter("label = 1"), k=3)


def test_more_folds_than_rows_of_any_class(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "row_id long, label int")
    with pytest.raises(ValueError):
        X.stratified_kfold(df, k=5)
    assert X.stratified_kfold(df, k=3).count() == 6
