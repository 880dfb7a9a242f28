"""Quality rules: base rules on each text, and the frequency of its lines across documents.

Lines are normalised (A-Z lower-cased, words joined by one blank) and hashed together with
their host, a document's ``source``.  For every host and line the different documents that hold it
are counted.  A line is common if it is in more than ``max_docs`` documents of the host and in more than
the share ``max_share`` of the host's documents.  Common lines are removed, and a document that loses more
than the share ``max_loss`` of its words is depleted and rejected, as is one that fails a
base rule: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent of its words in 8-word windows
that the text repeats.

Counting is one aggregation by (host, hash) with map-side sums, so a line in a third of all
documents costs one row a task; lines, not texts, are shuffled.  Rows that hold a line are counted
first; for ids that several rows share, the surplus is subtracted exactly, on those rows
alone.  The common lines' hashes are broadcast only if they measure at most ``BROADCAST_BYTES``;
beyond that the lines of every text are joined with them by a shuffle, with the same results.
Hashes have 64 bits: a line is mistaken for a common one of its host only if its hash
equals one of theirs.

Defined results: a null text is empty, has no words and fails; null sources are one host; a row
without an id is a document of its own; rows that share an id are one document in the counts and
are judged one by one; an empty table gives no rows; columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import materialize

#: A common line is in more documents of its host than this, ...
MAX_DOCS = 6
#: ... and in more than this share of them.
MAX_SHARE = 0.001
#: A document that loses more than this share of its words is rejected.
MAX_LOSS = 0.5
MIN_WORDS = 20
#: Percent of the words.
MAX_REPEATED = 30
WINDOW = 8
#: Largest table of common lines that every task holds.
BROADCAST_BYTES = 32 * 1024 * 1024

WORD = re.compile("[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included.

    Windows are numbered exactly: the numbers of a window twice as long are those of pairs of
    windows, each window beside the one that follows it."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number, size = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pair = number[:-step] * (int(number.max()) + 1) + number[step:]
        number, size = np.unique(pair, return_inverse=True)[1], size + step
    again = (np.bincount(number) > 1)[number]
    # a word is hit if one of the windows that cover it is repeated
    covering = np.cumsum(np.concatenate([again, np.zeros(window, dtype=np.int64)])) \
        - np.cumsum(np.concatenate([np.zeros(window, dtype=np.int64), again]))
    return int(np.count_nonzero(covering[:len(words)]))


def line_keys(text: str, host: str | None) -> list[tuple[int, str, int, int]]:
    """(place, line, key, words) of each line with a word; the key is a signed 64-bit hash of host and normalised line."""
    from xxhash import xxh64_intdigest
    seed = xxh64_intdigest("" if host is None else "h" + host)
    out = []
    for at, line in enumerate(text.split("\n")):
        words = WORD.findall(line)
        if words:
            h = xxh64_intdigest(" ".join(words).translate(LOWER).encode("utf-8", "surrogatepass"), seed)
            out.append((at, line, h - (1 << 64) if h >> 63 else h, len(words)))
    return out


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str, lines: list[tuple[int, str, int, int]]) -> list[int]:
    words = WORD.findall(text)
    return [len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len({x[1] for x in lines}), repeated_words(words)]


# ---------------------------------------------------------------- line frequencies

def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = [], []
        for i, (text, host) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
            own = {x[2] for x in line_keys(text.as_py() or "", host)}  # each line once a row
            rows.append(np.full(len(own), i))
            keys.append(np.fromiter(own, dtype=np.int64, count=len(own)))
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.record_batch([batch.column(1).take(at), batch.column(2).take(at), pa.array(np.concatenate(keys))],
                                  names=["host", "doc_id", "key"])


def line_rows(rows: DataFrame) -> DataFrame:
    """(host, doc_id, key): the different lines of each row."""
    return rows.select("text", "host", "doc_id").mapInArrow(_keys, "host string, doc_id long, key long")


def common_lines(rows: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, key) of the lines above both limits, from ``rows`` (doc_id, host, text)."""
    counted = line_rows(rows).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    repeated = materialize(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
                           .select(F.col("doc_id").alias("r_id")), "lines-repeated-ids")
    if not repeated.isEmpty():
        # what rows that share an id add to a host or line beyond one document
        several = rows.join(repeated, F.col("doc_id") == F.col("r_id"), "left_semi")

        def surplus(x: DataFrame, *by: str) -> DataFrame:
            return x.groupBy(*by, "doc_id").agg((F.count("*") - 1).alias("more")).groupBy(*[F.col(c).alias(f"s_{c}") for c in by]) \
                .agg(F.sum("more").alias("more"))

        def less(x: DataFrame, extra: DataFrame, n: str, *by: str) -> DataFrame:
            same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in by]
            return x.join(extra, same, "left").select(*by, (F.col(n) - F.coalesce("more", F.lit(0))).alias(n))

        counted = less(counted, surplus(line_rows(several), "host", "key"), "n", "host", "key").filter(F.col("n") > max_docs)
        hosts = less(hosts, surplus(several, "host"), "docs", "host")
    hosts = hosts.select(F.col("host").alias("d_host"), "docs")
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("d_host"))).filter(F.col("n") > max_share * F.col("docs")).select("host", "key")


# ---------------------------------------------------------------- judging

JUDGED = "doc_id long, text string, " + ", ".join(f"{c} long" for c in BASE) + ", n_removed_lines long, n_removed_words long"


def judge(text: str, host: str | None, common) -> tuple[str, list[int]]:
    """(the text without common lines, base counts, lines and words removed); ``common`` tells which keys are."""
    lines = line_keys(text, host)
    counts = base_counts(text, lines)
    out = [x for x, o in zip(lines, common([x[2] for x in lines]) if lines else []) if o]
    if not out:
        return text, [*counts, 0, 0]
    gone = {x[0] for x in out}
    left = "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)
    return left, [*counts, len(out), sum(x[3] for x in out)]


def _record(ids: pa.Array, judged: list[tuple[str, list[int]]]) -> pa.RecordBatch:
    return pa.record_batch([ids, pa.array([j[0] for j in judged], pa.string()),
                            *(pa.array([j[1][i] for j in judged], pa.int64()) for i in range(len(BASE) + 2))],
                           names=[c.split()[0] for c in JUDGED.split(", ")])


def _judge_broadcast(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shipped.value

        def common(own):
            if not len(keys):
                return [False] * len(own)
            at = np.searchsorted(keys, own)
            return (keys[np.minimum(at, len(keys) - 1)] == np.array(own, dtype=np.int64)).tolist()

        for batch in batches:
            yield _record(batch.column(0), [judge(t.as_py() or "", h, common) for t, h in zip(batch.column(1), batch.column(2).to_pylist())])

    return run


def _judge_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [set(k or ()) for k in batch.column(3).to_pylist()]
        yield _record(batch.column(0), [judge(t.as_py() or "", h, lambda own, s=s: [k in s for k in own])
                                        for t, h, s in zip(batch.column(1), batch.column(2).to_pylist(), sets)])


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (without common lines), base counts, n_removed_lines, n_removed_words, base_failed, depleted, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").alias("host"))
    common = materialize(common_lines(rows, max_docs, max_share), "common-lines")
    if common.count() * 8 <= broadcast_bytes:
        keys = np.sort(common.select("key").toArrow().column(0).to_numpy())
        judged = rows.mapInArrow(_judge_broadcast(docs.sparkSession.sparkContext.broadcast(keys)), JUDGED)
    else:
        # a number for every row, written so that it stays the same when a task is run again
        numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _keys(batches):
                yield found.rename_columns(["host", "row", "key"])

        lines = numbered.select("text", "host", F.col("row").alias("doc_id")).mapInArrow(keyed, "host string, row long, key long")
        theirs = lines.join(common.select(F.col("host").alias("c_host"), F.col("key").alias("c_key")).hint("merge"),
                            (F.col("key") == F.col("c_key")) & F.col("host").eqNullSafe(F.col("c_host"))) \
            .groupBy(F.col("row").alias("l_row")).agg(F.collect_list("key").alias("keys"))
        judged = numbered.join(theirs, F.col("row") == F.col("l_row"), "left").select("doc_id", "text", "host", "keys") \
            .mapInArrow(_judge_joined, JUDGED)
    few = F.col("n_words") < MIN_WORDS
    failed = few | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = F.col("n_removed_words") > max_loss * F.col("n_words")
    return judged.withColumns({"base_failed": failed, "depleted": depleted, "kept": ~failed & ~depleted})


def digest(found: DataFrame) -> DataFrame:
    """The rows of op12."""
    return found.select("doc_id", *BASE, "base_failed", "kept", "n_removed_lines", "n_removed_words")
