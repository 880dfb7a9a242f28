"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import ann, decontam, fim, langid, lines, packing, pii, secrets, simhash, tokens, toxicity, walsh, warc
from claimlens.llm import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_pii")
def op1_pii(spark, sf_dir):
    """Personal data of every document by weak supervision."""
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


@register("op2_simhash")
def op2_simhash(spark, sf_dir):
    """SimHash fingerprints and components of all documents."""
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


@register("op3_decontamination", Q.OP3)
def op3_decontamination(spark, sf_dir):
    """Benchmark windows in every document, by a positional inverted index."""
    return decontam.digest(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


@register("op4_ann")
def op4_ann(spark, sf_dir):
    """The 20 nearest embeddings of every 20th one, by a permutation index."""
    rows = ann.usable(_table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.filter("vec_id % 20 = 0"))


@register("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document by a classifier chain fitted on the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", "toxic", "p_toxic", "p_low_quality")


@register("op6_warc", Q.OP6)
def op6_warc(spark, sf_dir):
    """Every page written to WARC archives and read back by headers."""
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


@register("op7_secret_scan", Q.OP7)
def op7_secret_scan(spark, sf_dir):
    """Secrets of every document, by way of a blob ledger."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


@register("op8_language_id")
def op8_language_id(spark, sf_dir):
    """The language of every document by nearest centroids."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@register("op9_token_store")
def op9_token_store(spark, sf_dir):
    """Token ids of every document, written to and read back from the Parquet token store."""
    return tokens.store_digest(_table(spark, sf_dir, "documents"))


@register("op10_packing")
def op10_packing(spark, sf_dir):
    """Every document packed into windows of 4,096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@register("op11_centroid_clustering", Q.OP11)
def op11_centroid_clustering(spark, sf_dir):
    """40 centroids of the embeddings, searched in Walsh-Hadamard space."""
    return walsh.digest(*walsh.cluster(walsh.usable(_table(spark, sf_dir, "embeddings"))))


@register("op12_quality_rules", Q.OP12)
def op12_quality_rules(spark, sf_dir):
    """Base rules and the frequency of lines across the documents of a host."""
    return lines.digest(lines.quality(_table(spark, sf_dir, "documents")))


@register("op13_fill_in_middle", Q.OP13)
def op13_fill_in_middle(spark, sf_dir):
    """Every document in fill-in-the-middle form, and its text rebuilt from that."""
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents")))
