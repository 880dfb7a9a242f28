"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, PII, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents; the last one returns
the pieces of packed windows.

Defined results, beside those of the operators: null ids are ids like any other
and rows with them are judged by their texts; of rows that repeat an id within
one near-duplicate group one stays; an empty table passes through; columns
beside those of documents are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontam, langid, packing, pii, simhash
from claimlens.session import materialize

#: What a stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1 (operator 8): learn from the documents with a language that are not held out;
    documents without a letter, or too far from every centroid, go."""
    rows = docs.select(*COLUMNS)
    model = langid.fit(rows.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(rows, model).filter(~F.col("rejected")).select(*COLUMNS)


def _row_key() -> Column:
    """Tells rows apart that share an id but not the text; full repeats share it."""
    return F.xxhash64("doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2 (operator 2): of each near-duplicate component the document with the smallest id stays."""
    rows = docs.select(*COLUMNS, _row_key().alias("row"))
    found = materialize(simhash.near_duplicates(rows, keep="row"), "dedup-found")
    # without any id in it, a fingerprint is a component of its own
    group = F.when(F.col("part").isNull(), F.col("fp"))
    best = found.groupBy("part", group.alias("g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = best.select(F.col("best.row").alias("b_row"))
    stay = rows.join(best.hint("shuffle_hash"), F.col("row") == F.col("b_row"), "left_semi")
    repeats = materialize(found.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1")
                          .select(F.col("row").alias("r_row")).join(best, F.col("r_row") == F.col("b_row"), "left_semi"), "dedup-repeats")
    if not repeats.isEmpty():  # the same id and text in several rows: one of them
        same = F.col("row") == F.col("r_row")
        stay = stay.join(repeats, same, "left_anti").union(stay.join(repeats, same, "left_semi").dropDuplicates(["row"]))
    return stay.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3 (operator 3): documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, _row_key().alias("row"))
    found = decontam.contamination(rows.select(F.col("row").alias("doc_id"), "text"), benchmark)
    hit = materialize(found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("h_row")), "decontam-hits")
    return rows.join(hit, F.col("row") == F.col("h_row"), "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4 (operator 1): every span of personal data becomes a mark of its kind."""
    found = pii.detect(docs.select(*COLUMNS), keep=COLUMNS)
    text = pii.redact(F.col("row.text"), F.col("spans"))
    return found.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5 (operator 10): pieces in windows of 4,096 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("decontamination", decontaminate),
          ("pii", redact), ("packing", pack_windows)]

#: SQL cannot express k-means, XXH64 or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each but the last written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
