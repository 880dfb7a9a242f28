"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The
ledger, a Parquet table, has one row for each blob and rule version that has
been scanned, with the findings.  A scan reads only (blob, rule version) pairs
that the ledger lacks, appends them and joins findings back to all paths.

Texts move once, in a join on (path, blob) with the one path chosen for each
unseen blob, so a blob that a third of all paths share is one row of that join.
The join back carries only blobs that have findings; a hot blob is one row of
it on the ledger's side, and AQE splits the side of the paths.

Defined results: null text counts as the empty text; null paths are paths like
any other (they equal each other); repeated rows are scanned once and each
returned; an empty table gives no rows; columns beside the two named ones are
ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import spans as S
from claimlens.session import materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regex; capture group ``group`` must have ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""  # a literal that every match contains: texts without it are not searched


# Possessive quantifiers and the look-behind keep the search linear; they change no match.
RULES = [
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]++", 0, 16, "AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
    # added by this scanner beside the three base kinds
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40, "gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30, "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, "-----BEGIN "),
]
BASE = ["assign", "access", "hex"]

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def _findings(text: Column, rule: Rule) -> Column:
    searched = F.when(text.contains(rule.needs), text) if rule.needs else text
    raw = S.raw_spans(searched, rule.pattern, rule.group)
    kept = F.filter(raw, lambda s: F.length(s["part"]) >= rule.least)
    return F.transform(F.coalesce(kept, F.array().cast(raw_type)),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


raw_type = "array<struct<i:int,start:int,end:int,match:string,part:string,before:string,after:string>>"


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, text, blob): the content address of every version."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), t.alias("text"), F.sha2(t, 256).alias("blob"))


def without_repeats(vers: DataFrame) -> DataFrame:
    """``vers`` with one row a path and blob.  Rows are compared by hashes; only the few that share one are
    reduced, in their own tasks first, so a row that a third of all rows repeat is one a task."""
    h = F.xxhash64("path", "blob")
    same = materialize(vers.select(h.alias("s_h")).groupBy("s_h").agg(F.count("*").alias("n")).filter("n > 1").select("s_h"), "repeated-versions")
    if same.isEmpty():
        return vers
    once = vers.join(same, h == F.col("s_h"), "left_anti")
    return once.unionByName(vers.join(same, h == F.col("s_h"), "left_semi").dropDuplicates(["path", "blob"]))


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger) if ledger else spark.createDataFrame([], LEDGER_SCHEMA)


def scan_unseen(vers: DataFrame, ledger: str | None, out: str, rules: list[Rule] = RULES) -> int:
    """Scan the (blob, rule version) pairs that ``ledger`` lacks and append them to the Parquet
    table ``out`` (which may be the ledger itself).  Returns the number of pairs scanned."""
    spark = vers.sparkSession
    vers = without_repeats(vers)
    want = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = read_ledger(spark, ledger).select("blob", "kind", "version").groupBy("blob").agg(
        F.collect_set(F.struct("kind", "version")).alias("seen"))  # at most one element a rule version
    chosen = vers.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger:
        chosen = chosen.join(seen, "blob", "left").select(
            "blob", "path", F.array_except(want, F.coalesce("seen", F.array().cast(
                "array<struct<kind:string,version:int>>"))).alias("todo")).filter(F.size("todo") > 0)
    else:
        chosen = chosen.select("blob", "path", want.alias("todo"))
    c = chosen.select(F.col("blob").alias("c_blob"), F.col("path").alias("c_path"), "todo")
    texts = vers.join(c.hint("shuffle_hash"), (F.col("blob") == F.col("c_blob")) & F.col("path").eqNullSafe(F.col("c_path")))
    found = texts.select("blob", *[
        F.when(F.array_contains(F.col("todo"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
               _findings(F.col("text"), r)).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                               F.col(f"r{i}").alias("spans")) for i, r in enumerate(rules)])
    scanned = found.select("blob", F.explode(F.filter(pairs, lambda p: p["spans"].isNotNull())).alias("p")) \
        .select("blob", "p.*")
    written = Observation()
    scanned.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out)
    return written.get["n"]


def findings_by_blob(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, found: array<(start, kind number, end)> sorted) of blobs with findings of these rule versions."""
    kind = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}@{r.version}"), F.lit(i))])
    number = F.try_element_at(kind, F.concat_ws("@", "kind", F.col("version").cast("string")))
    rows = ledger.withColumn("number", number).filter(F.col("number").isNotNull() & (F.size("spans") > 0)) \
        .dropDuplicates(["blob", "number"])  # a pair scanned twice after a lost append counts once
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.col("number").alias("kind"), s["end"].alias("end")))))).alias("found"))


def scan(docs: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES,
         path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan all versions; return (path, blob, found) for every row of ``docs``.

    ``ledger`` is a Parquet folder that grows with every call; without one the scan
    starts from an empty ledger in the shared scratch folder.
    """
    spark = docs.sparkSession
    vers = versions(docs, path, text)
    at = ledger or scratch_path(spark, "secret-ledger")
    known = ledger if ledger and _exists(spark, ledger) else None
    scan_unseen(vers, known, at, rules)
    hits = findings_by_blob(read_ledger(spark, at), rules)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return vers.select(F.col("path").alias("v_path"), F.col("blob").alias("v_blob")) \
        .join(hits, F.col("v_blob") == F.col("blob"), "left") \
        .select(F.col("v_path").alias(path), F.col("v_blob").alias("blob"), F.coalesce("found", none).alias("found"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def digest(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The counts and hashes that op7 returns."""
    kinds = [r.kind for r in rules]
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(S.joined(base, kinds), 256).alias("base_sha256"), S.joined(F.col("found"), kinds).alias("spans"))
