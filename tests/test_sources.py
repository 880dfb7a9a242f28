"""CSV reading rules (FIXTURES 3.4), JSON/CSV sinks, run log, saved models, streaming."""

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources import files as FS
from claimlens.operators import reports as R

CSV = ('﻿mani_news,original_news_article,mani_status,altered_excerpt,original_excerpt,category,data_type\n'
       '"Claim one","Line 1\nLine 2 with ""quotes"" and a \\\\ backslash",MANI,NA,,,TRAIN\n'
       '123,"body",NO_MANI,"",x,cat,TEST\n'
       'c3,a3,MANI,ex,,,DEV\n')


def test_claims_csv(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "claims.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(CSV)
    raw = sorted(FS.read_claims_csv(spark, p).collect(), key=lambda r: ["Claim one", "123", "c3"].index(r["mani_news"]))
    assert len(raw) == 3
    assert raw[0]["mani_news"] == "Claim one"
    assert raw[0]["original_news_article"] == 'Line 1\nLine 2 with "quotes" and a \\\\ backslash'
    assert raw[0]["altered_excerpt"] is None and raw[0]["original_excerpt"] is None
    assert raw[1]["mani_news"] == "123" and raw[1]["altered_excerpt"] is None
    en = FS.load_claims(spark, p).orderBy(F.desc("data_type")).collect()
    assert [r["data_type"] for r in en] == ["TRAIN", "TEST"]
    assert [r["label"] for r in en] == [1, 0]
    assert en[0]["text_concat"] == 'Claim one Line 1 Line 2 with "quotes" and a \\\\ backslash'
    assert en[1]["has_excerpt"] == 0 and en[0]["has_excerpt"] == 0


def test_row_ids_do_not_depend_on_files(spark):
    head, rows = CSV.split("\n", 1)[0], ["a,b,MANI,,,,TRAIN", "c,d,NO_MANI,,,,TEST", "a,b,MANI,,,,TRAIN", "e,f,MANI,,,,TEST"]
    got = []
    for parts in ([rows], [rows[2:], rows[:2]], [[r] for r in reversed(rows)]):
        d = tempfile.mkdtemp()
        for i, part in enumerate(parts):
            with open(os.path.join(d, f"{i}.csv"), "w", encoding="utf-8") as f:
                f.write("\n".join([head, *part]) + "\n")
        got.append(sorted((r["row_id"], r["mani_news"]) for r in FS.read_claims_csv(spark, d).collect()))
    assert got[0] == got[1] == got[2] and len({i for i, _ in got[0]}) == 4


def test_csv_key_and_parquet(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "k.csv"), "w", encoding="utf-8") as f:
        f.write("id,mani_news,original_news_article,mani_status,altered_excerpt,original_excerpt,category,data_type\n7,a,b,MANI,,,,TRAIN\n")
    schema = T.StructType([T.StructField("id", T.StringType()), *FS.CLAIM_CSV_SCHEMA.fields])
    raw = FS.read_claims_csv(spark, d, schema, key="id")
    assert raw.first()["row_id"] == 7 and "id" not in raw.columns
    with open(os.path.join(d, "claims.csv"), "w", encoding="utf-8") as f:
        f.write(CSV)
    table = FS.ingest_claims(spark, os.path.join(d, "claims.csv"), os.path.join(d, "claims.parquet"))
    assert table.count() == 3 and table.columns[0] == "row_id"


def test_term_counts_move_texts_once_from_csv(spark):
    from claimlens.operators import tfidf
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "claims.csv"), "w", encoding="utf-8") as f:
        f.write(CSV)
    key = FS.read_claims_csv(spark, os.path.join(d, "claims.csv"), key=None)
    plan = tfidf.term_counts(key.select("row_id", "mani_news"), "mani_news", tfidf.WORD)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "Exchange" not in above   # exploded n-grams never move


def test_json_roundtrip_keeps_text(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("বাংলা", 0.5, None)], "model string, f1 double, auc double")
    FS.write_json(df, os.path.join(d, "r"))
    back = FS.read_json(spark, os.path.join(d, "r")).first()
    assert back["model"] == "বাংলা" and back["f1"] == 0.5
    parts = [os.path.join(d, "r", f) for f in os.listdir(os.path.join(d, "r")) if f.endswith(".json")]
    raw = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert "বাংলা" in raw


def test_leaderboard_csv_roundtrip(spark):
    d = tempfile.mkdtemp()
    lb = R.leaderboard([R.inline_results(spark)])
    FS.write_csv(lb, os.path.join(d, "lb"))
    back = FS.read_csv(spark, os.path.join(d, "lb"), R.RESULT_SCHEMA)
    assert back.count() == len(R.PUBLISHED_RESULTS)
    assert back.filter(F.col("roc_auc").isNull()).count() == 3


def test_run_log_append(spark):
    d = os.path.join(tempfile.mkdtemp(), "log")
    sch = T.StructType([T.StructField("seed", T.LongType()), T.StructField("f1", T.DoubleType())])
    assert FS.read_run_log(spark, d, sch).count() == 0
    for s in range(3):
        FS.append_run_log(spark.createDataFrame([(s, 0.5 + s / 10)], sch), d)
    assert sorted(r["seed"] for r in FS.read_run_log(spark, d, sch).collect()) == [0, 1, 2]
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not a record\n")
    log = FS.read_run_log(spark, d, sch).collect()
    assert [r[FS.CORRUPT] for r in log if r[FS.CORRUPT]] == ["{not a record"] and len(log) == 4


def test_model_save_load(spark):
    d = os.path.join(tempfile.mkdtemp(), "m")
    vocab = spark.createDataFrame([("aa", 0, 1.5)], "term string, idx long, idf double")
    coef = spark.createDataFrame([("aa", 0, 0.25)], "term string, idx long, coef double")
    FS.save_model(d, vocab, coef, -0.1, {"loss": "logistic"})
    v, c, meta = FS.load_model(spark, d)
    assert v.count() == 1 and c.first()["coef"] == 0.25 and meta == {"loss": "logistic", "intercept": -0.1}


def test_run_log_keeps_one_append_a_run(spark, tmp_path):
    d = str(tmp_path / "log")
    sch = T.StructType([T.StructField("seed", T.LongType()), T.StructField("f1", T.DoubleType())])

    def rows(*values):
        return spark.createDataFrame([(v, 0.5) for v in values], sch)

    def seen(log):
        return sorted(r["seed"] for r in log.collect())

    FS.append_run_log(rows(1, 2), d, run="a")
    FS.append_run_log(rows(1, 2), d, run="a")                 # a replay
    FS.append_run_log(rows(3), d, run="b", attempt=1)
    FS.append_run_log(rows(4), d, run="b", attempt=0)         # an earlier attempt that comes late
    FS.append_run_log(rows(9), d)
    assert seen(FS.read_run_log(spark, d, sch)) == [1, 2, 3, 9]
    # concurrent appends lose none
    threads = [threading.Thread(target=FS.append_run_log, args=(rows(100 + i), d, f"t{i}")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen(FS.read_run_log(spark, d, sch)) == [1, 2, 3, 9, 100, 101, 102, 103]
    new = str(tmp_path / "compact")
    assert seen(FS.compact_run_log(spark, d, sch, new)) == [1, 2, 3, 9, 100, 101, 102, 103]
    assert len([f for f in os.listdir(new) if f.endswith(".json")]) == 1
    FS.append_run_log(rows(5), new, run="a", attempt=2)
    assert seen(FS.read_run_log(spark, new, sch)) == [3, 5, 9, 100, 101, 102, 103]


def test_an_unfinished_model_is_passed_over(spark, tmp_path):
    d = str(tmp_path / "m")
    vocab = spark.createDataFrame([("aa", 0, 1.5)], "term string, idx long, idf double")

    def coef(x):
        return spark.createDataFrame([("aa", 0, x)], "term string, idx long, coef double")

    broken = coef(0.0).select("term", "idx", F.raise_error(F.lit("lost")).cast("double").alias("coef"))
    with pytest.raises(FileNotFoundError):
        FS.load_model(spark, d)
    first = FS.save_model(d, vocab, coef(0.25), -0.1, {"loss": "logistic"})
    with pytest.raises(Exception, match="lost"):
        FS.save_model(d, vocab, broken, -0.2, {"loss": "logistic"})    # ends between the tables
    assert FS.model_versions(spark, d) == [first]
    assert FS.load_model(spark, d)[2]["intercept"] == -0.1
    second = FS.save_model(d, vocab, coef(0.5), -0.3, {"loss": "logistic"})
    assert FS.model_versions(spark, d) == [first, second]
    assert FS.load_model(spark, d)[1].first()["coef"] == 0.5 and FS.load_model(spark, d, first)[1].first()["coef"] == 0.25


def test_preview(spark):
    df = spark.createDataFrame([("x" * 500,), ("y",)], "t string")
    p = FS.preview(df, "t").collect()
    assert len(p) == 1 and len(p[0]["t"]) == 300
