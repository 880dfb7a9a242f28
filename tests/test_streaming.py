"""Streaming scoring with a batch-fitted model equals batch scoring."""

import os
import tempfile

from pyspark.sql import functions as F

from claimlens.operators import linear as L
from claimlens.operators import tfidf as T
from claimlens.plans import baseline as B
from claimlens.sources import tables as S
from claimlens.streaming import scoring as ST
from tests.conftest import SF_SMALL


def test_stream_scores_match_batch(spark):
    claims = S.claims(spark, SF_SMALL)
    model, preds = B.fit_text_model(claims, T.WORD, L.LOGREG)
    d = tempfile.mkdtemp()
    src = os.path.join(d, "in")
    S.claims_view(spark, SF_SMALL).filter("data_type = 'TEST'").write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = ST.start_scoring(ST.stream_claims(spark, src, schema=schema), model.vocab, model.coef, model.intercept,
                         L.LOGREG, T.WORD, os.path.join(d, "out"), os.path.join(d, "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    got = {r["row_id"]: r["prob"] for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    want = {r["row_id"]: r["prob"] for r in preds.filter("data_type = 'TEST'").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9
