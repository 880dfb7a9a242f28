"""Parquet table access and the claim-table views built from the driver's tables.

The reference reads a CSV of (claim, article, status, excerpt, split) rows; the
test tables hold no such file, so ``claims_view`` derives the same shape from
``documents`` and ``labels`` (see FIXTURES.md §2).  Everything downstream only
needs the raw claim schema, whichever source produced it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.text import (
    STRATEGIES, compose_text, is_present, label_binarize, text_length,
)

RAW_COLUMNS = ("mani_news", "original_news_article", "mani_status",
               "altered_excerpt", "category", "data_type")
SPLITS = ("TRAIN", "TEST")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the test data (column pruning/pushdown happen at the scan)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claim rows: ``row_id`` + the reference's CSV columns.

    Quality plays the class; the split is label-dependent on purpose, to
    recreate a train/test prior shift.  The join of documents with labels is
    left to the planner: AQE turns it into a broadcast join only when the
    labels side is measured small, otherwise it stays a shuffled join.  Texts
    of documents without a label never move further than that join.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.trim(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("mani_news"),
        F.col("text").alias("original_news_article"),
        F.when(F.col("quality") == 1, F.lit("MANI")).otherwise(F.lit("NO_MANI")).alias("mani_status"),
        F.when(F.col("toxic") == 1, F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("altered_excerpt"),
        F.col("source").alias("category"),
        F.when(((F.col("quality") == 1) & (F.col("doc_id") % 10 == 0))
               | ((F.col("quality") == 0) & (F.col("doc_id") % 3 == 0)), F.lit("TEST"))
        .otherwise(F.lit("TRAIN")).alias("data_type"),
    )


def enrich_claims(raw: DataFrame) -> DataFrame:
    """The loaded-sample table: label, four composed texts, length features.

    Rows whose split is neither TRAIN nor TEST are dropped (first, so the
    filter reaches the scan); raw columns are kept for prompts.
    """
    composed = [compose_text("mani_news", "original_news_article", "altered_excerpt", s)
                .alias(f"text_{s}") for s in STRATEGIES]
    return raw.filter(F.col("data_type").isin(*SPLITS)).select(
        "row_id", "data_type",
        label_binarize("mani_status").alias("label"),
        "mani_news", "original_news_article", "mani_status", "altered_excerpt", "category",
        *composed,
        text_length("mani_news").alias("claim_len"),
        text_length("original_news_article").alias("article_len"),
        is_present("altered_excerpt").alias("has_excerpt"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched claims of the test tables."""
    return enrich_claims(claims_view(spark, sf_dir))


def scored_view(enriched: DataFrame) -> DataFrame:
    """Deterministic scores with ties, so metric operators need no model."""
    score = ((F.lit(35) * F.col("label") + (F.col("row_id") * 7919) % 65) / F.lit(100.0))
    return enriched.select("row_id", "data_type", "label", score.cast("double").alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_view(claims(spark, sf_dir))


def claim_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim/article pairs at a second shape: a user turn and the next turn.

    Equi-join on (conv_id, turn + 1): both sides shuffle on the same keys.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    q = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("mani_news"))
    a = conv.select("conv_id", (F.col("turn") - 1).alias("turn"),
                    F.col("text").alias("original_news_article"))
    return q.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", "mani_news", "original_news_article")
