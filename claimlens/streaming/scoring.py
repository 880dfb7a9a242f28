"""Score claims as they arrive, with a model fitted in batch.

Everything per row (cleaning, composition, n-grams) runs unchanged on a
streaming DataFrame.  The fitted vocabulary and coefficients are static
tables, so each micro-batch is a stream-static join; the per-row sum of
weight x coefficient is computed inside ``foreachBatch`` (per micro-batch,
an ordinary batch aggregation keyed by row), which needs no streaming state,
and each batch's results replace that batch's partition of the sink, so a
replayed batch after a failure is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.text import compose_text, label_binarize
from claimlens.operators import models as MD
from claimlens.operators import tfidf as T
from claimlens.operators.linear import LinearSpec
from claimlens.sources.tables import RAW_COLUMNS


def stream_claims(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Raw claim rows (``row_id`` + raw columns) from files landing in ``path``."""
    r = spark.readStream.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def prepare(stream: DataFrame, strategy: str = "concat") -> DataFrame:
    """P1-P3 on a stream: label and composed text."""
    return stream.select("row_id", label_binarize("mani_status").alias("label"),
                         compose_text("mani_news", "original_news_article", "altered_excerpt", strategy)
                         .alias("text"))


def batch_scorer(vocab: DataFrame, coef: DataFrame, intercept: float, spec: LinearSpec,
                 cfg: T.TfidfConfig, sink_path: str):
    """A ``foreachBatch`` function writing (batch_id, row_id, label, margin, prob, prediction)."""
    n_vocab = vocab.select("term", "idx", "idf")

    def score(batch: DataFrame, batch_id: int) -> None:
        tf = T.term_counts(batch, "text", cfg)
        w = T.tfidf_weights(tf, n_vocab, sublinear_tf=cfg.sublinear_tf)
        out = MD.predict(w, batch.select("row_id", "label"), coef, intercept, spec)
        # dynamic partition overwrite: a replayed batch replaces its own output
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink_path)

    return score


def start_scoring(stream: DataFrame, vocab: DataFrame, coef: DataFrame, intercept: float, spec: LinearSpec,
                  cfg: T.TfidfConfig, sink_path: str, checkpoint: str, trigger_once: bool = False):
    """Start the streaming query; the checkpoint folder makes it restartable."""
    w = prepare(stream).writeStream.foreachBatch(batch_scorer(vocab, coef, intercept, spec, cfg, sink_path)) \
        .option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


__all__ = ["stream_claims", "prepare", "batch_scorer", "start_scoring", "RAW_COLUMNS"]
