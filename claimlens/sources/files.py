"""File sources and sinks: the claim CSV, JSON result files, CSV leaderboards,
append-only run logs, saved models and previews.

Writers produce Spark output folders (part files), so any number of tasks
can write in parallel and a failed task's attempt is discarded atomically.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.tables import RAW_COLUMNS, enrich_claims

# The tokens pandas' CSV reader turns into missing values
# (exact, case-sensitive match on the whole field).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

CLAIM_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in
                                 ("mani_news", "original_news_article", "mani_status", "altered_excerpt",
                                  "original_excerpt", "category", "data_type")])


def read_claims_csv(spark: SparkSession, path: str, schema: T.StructType = CLAIM_CSV_SCHEMA,
                    key: str | None = None) -> DataFrame:
    """Raw claim rows from a header CSV: explicit string schema (digits stay
    text), quoted newlines kept, doubled quotes unescaped, pandas' missing
    tokens -> NULL, and a ``row_id``.

    ``row_id`` depends on neither file order nor partitioning, so folds, holdouts and
    samples (which hash it) stay the same: it is the column ``key`` (a number) if the file has
    one, else a hash of the row's content and of its number among equal rows.

    multiLine CSV files are not splittable, so parallelism comes from the number of
    files: ``ingest_claims`` converts them to parquet once."""
    df = (spark.read.schema(schema)
          .option("header", True).option("multiLine", True).option("escape", '"')
          .option("encoding", "UTF-8")
          .csv(path))
    tokens = F.array(*[F.lit(t) for t in NULL_TOKENS])
    cleaned = [F.when(F.array_contains(tokens, F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
               for c in df.columns]
    if key:
        return df.select(F.col(key).cast("long").alias("row_id"), *[c for c, n in zip(cleaned, df.columns) if n != key])
    rows = df.select(*cleaned).withColumn("_h", F.xxhash64(*df.columns))
    # equal rows are few, so a window over the content hash is small whatever the file
    same = F.row_number().over(Window.partitionBy("_h").orderBy(*df.columns))
    return rows.withColumn("_n", same).select(F.xxhash64("_h", "_n").alias("row_id"), *df.columns)


def ingest_claims(spark: SparkSession, path: str, out: str, key: str | None = None) -> DataFrame:
    """Convert claim CSV files to a parquet table once; read that from then on."""
    read_claims_csv(spark, path, key=key).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def load_claims(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """CSV -> enriched claims (label, composed texts, length features);
    split into TRAIN/TEST by filtering ``data_type``."""
    return enrich_claims(read_claims_csv(spark, path, key=key).select("row_id", *RAW_COLUMNS))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: JSON lines, UTF-8 with non-ASCII text kept as is."""
    df.write.mode(mode).option("encoding", "UTF-8").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multi_line: bool = False) -> DataFrame:
    """JSON records (JSON lines, or ``multi_line=True`` for a JSON array file)."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV without an index column."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


#: Columns of a log line beside the record's own: the run it belongs to, which attempt of the run
#: wrote it, and which append.
LOG_KEYS = T.StructType([T.StructField("log_run", T.StringType()), T.StructField("log_attempt", T.IntegerType()),
                         T.StructField("log_append", T.StringType())])
#: Holds the text of a log line that is no record of the schema.
CORRUPT = "corrupt_record"


def append_run_log(record: DataFrame, path: str, run: str | None = None, attempt: int = 0) -> None:
    """Append one run's records; readers see all runs (no read-modify-write, so
    concurrent runs cannot lose each other's rows).

    Every append is a folder of its own (jobs that write into one folder at the same time clear
    away each other's files) and carries the run's key, the attempt and a key of its own.  Of a run readers
    see one append, the last one of its latest attempt, so a replayed job stores nothing
    twice.  Without ``run`` an append is a run of its own."""
    own = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    record.select("*", F.lit(run if run is not None else own).alias("log_run"), F.lit(int(attempt)).alias("log_attempt"),
                  F.lit(own).alias("log_append")).write.mode("errorifexists").json(f"{path}/append-{own}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _log_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines of every run's latest append, with their keys."""
    full = T.StructType([*schema.fields, *LOG_KEYS.fields, T.StructField(CORRUPT, T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    lines = spark.read.schema(full).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    # one row a run
    last = lines.filter("log_run IS NOT NULL").groupBy(F.col("log_run").alias("l_run")) \
        .agg(F.max_by("log_append", F.struct("log_attempt", "log_append")).alias("l_append"))
    kept = lines.join(last, F.col("log_run") == F.col("l_run"), "left").filter(F.col("l_run").isNull() | (F.col("log_append") == F.col("l_append")))
    return kept.select(*full.fieldNames())


def read_run_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of every run's latest append; a missing log is empty.

    Lines without a run's key are kept all.  Lines that are no record are kept too, with their text in
    ``corrupt_record`` (null for good records); any other trouble with the path is raised."""
    return _log_lines(spark, path, schema).drop(*LOG_KEYS.fieldNames())


def compact_run_log(spark: SparkSession, path: str, schema: T.StructType, to: str, files: int = 1) -> DataFrame:
    """Write what readers of the log at ``path`` see now as a new log at ``to``, in few files, and read it there.

    The old log stays as it is, so a reader or a writer that still uses it loses nothing; runs keep their
    keys, so a later attempt still takes an earlier one's place."""
    _log_lines(spark, path, schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT).coalesce(files).write.mode("errorifexists").json(to)
    return read_run_log(spark, to, schema)


def save_model(path: str, vocab: DataFrame, coef: DataFrame, intercept: float, meta: dict) -> str:
    """Publish a fitted text model as a new version: vocabulary+idf, coefficients, and last of all its manifest.

    Versions are folders of their own, so a reader never meets the tables of two models, and
    a version that was not finished has no manifest and is passed over.  Returns the version."""
    spark = vocab.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    vocab.write.parquet(f"{path}/{version}/vocabulary")
    coef.write.parquet(f"{path}/{version}/coefficients")
    head = dict(meta, intercept=float(intercept))
    spark.createDataFrame([(json.dumps(head),)], "meta string").coalesce(1).write.text(f"{path}/{version}/manifest")
    return version


def model_versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a model, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in names if n.startswith("version-") and _exists(spark, f"{path}/{n}/manifest/_SUCCESS")]


def load_model(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(vocabulary, coefficients, meta) of the newest finished version, or of the one named."""
    if version is None:
        versions = model_versions(spark, path)
        if not versions:
            raise FileNotFoundError(f"no finished model version at {path}")
        version = versions[-1]
    at = f"{path}/{version}"
    meta = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    return spark.read.parquet(f"{at}/vocabulary"), spark.read.parquet(f"{at}/coefficients"), meta


def preview(df: DataFrame, text_col: str | None = None, n_chars: int = 300, rows: int = 1) -> DataFrame:
    """The first rows, long text cut to ``n_chars`` for display."""
    out = df.limit(rows)
    if text_col:
        out = out.withColumn(text_col, F.substring(text_col, 1, n_chars))
    return out
