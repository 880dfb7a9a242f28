"""Shared by the tests of the training-data operators."""

from tests.conftest import SF_SMALL

DOCS = f"{SF_SMALL}/documents.parquet"


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
