"""Plan-shape guards: no cartesian products anywhere, one shuffle of the texts."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL_QUERIES = sorted(E.oracle_sql())


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_no_cartesian_products(spark, name):
    p = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_text_path_has_one_exchange(spark):
    df = E.queries()["word_term_counts"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the documents are hash-partitioned once; n-gram counting adds no exchange
    assert p.count("Exchange hashpartitioning") == 1, p


def test_filters_and_columns_reach_the_scan(spark):
    df = E.queries()["split_distribution"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # only the id is read from documents: the text column is pruned at the scan
    assert "ReadSchema: struct<doc_id:bigint>" in p
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in p
    assert "PushedFilters: [IsNotNull(doc_id)]" in p


def test_robustness_report_sections(spark):
    from claimlens.plans import robustness as RBR
    from claimlens.sources import tables as S
    c = S.claims(spark, SF_SMALL)
    r = RBR.robustness_report(c, seeds=range(2), k=2).first()
    assert r["repeated_stratified_kfold"]["n_runs"] == 4
    assert r["restratified_650_150_splits"]["n_seeds"] == 2
    for sec in ("repeated_stratified_kfold", "restratified_650_150_splits"):
        s = r[sec]
        assert s["ci_95_lower"] <= s["mean_f1"] <= s["ci_95_upper"] and s["std_f1"] >= 0
    assert 0.0 <= r["threshold_calibration"]["calibrated_f1"] <= 1.0
