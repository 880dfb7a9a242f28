"""Relational TF-IDF: term counts, vocabulary fit, weighting, L2 norm, vectors.

Data layout: a long table ``(row_id, term, tf)`` instead of a sparse matrix.

Partitioning plan (one shuffle of the texts, one of the term statistics):
  1. texts are hash-partitioned by ``row_id``, into as many partitions as their measured length
     asks for, so that a task's table of counts has the same size whatever the input;
  2. n-grams are counted per (row_id, term) inside those partitions, in Arrow batches (``grams``) -- no exchange;
  3. document frequency is a ``groupBy(term)`` of counts that the tasks have
     added up (frequent terms are combined before the shuffle);
  4. the vocabulary holds at most ``max_features`` rows, so it is broadcast
     behind a measured size check;
  5. fits work on 64-bit term ids (``Terms``): the (row, id) counts are written once, vocabulary
     and weights run on longs, and strings are looked up once, for the terms that a
     vocabulary may hold; terms that share an id are found there, and the ids drawn anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.ngrams import char_wb_ngrams, char_wb_words, word_ngrams, word_tokens
from claimlens.operators import grams as G
from claimlens.session import materialize


@dataclass(frozen=True)
class TfidfConfig:
    analyzer: str                 # 'word' or 'char_wb'
    ngram_range: tuple[int, int]
    max_features: int | None
    min_df: int = 2
    sublinear_tf: bool = True
    mark_aware: bool = False

    def ngrams(self, col) -> Column:
        if self.analyzer == "word":
            return word_ngrams(col, self.ngram_range, self.mark_aware)
        if self.analyzer == "char_wb":
            return char_wb_ngrams(col, self.ngram_range)
        raise ValueError(f"Unknown analyzer: {self.analyzer}")

    @property
    def chars(self) -> bool:
        return self.analyzer == "char_wb"

    def tokens(self, col) -> Column:
        """The words that ``grams`` counts n-grams of, or inside."""
        return char_wb_words(col) if self.chars else word_tokens(col, self.mark_aware)


# Fixed values of the reference's two feature configurations.
WORD = TfidfConfig("word", (1, 3), 80_000)
CHAR = TfidfConfig("char_wb", (2, 5), 100_000)

# Largest vocabulary (estimated bytes) shipped to every task as a broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

#: Characters of text in one partition of the term counts: its table of counts takes some 200 MB.
PART_CHARS = 1_500_000
#: Partitions of texts whose different terms one task adds up.
TERM_PARTS = 4


def text_partitions(df: DataFrame, text_col: str) -> int:
    """Partitions that the n-grams of ``df``'s texts need, by their measured length; at least one a core."""
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / PART_CHARS))


def by_row(df: DataFrame, text_col: str, cols: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """The texts hash-partitioned by the first of ``cols``.  A number of partitions that is given is not
    coalesced: adaptive execution goes by the bytes of the texts, which their n-grams exceed many times."""
    d = df.select(*cols, text_col)
    if df.isStreaming:
        return d.repartition(cols[0])
    return d.repartition(text_partitions(df, text_col) if parts is None else parts, cols[0])


def counted_words(d: DataFrame, text_col: str, cols: tuple[str, ...]) -> DataFrame:
    """(cols..., _word, _n): whitespace-separated words of each row; their n-grams are cut once."""
    return d.select(*cols, F.explode(char_wb_words(text_col)).alias("_word")).groupBy(*cols, "_word").agg(F.count(F.lit(1)).alias("_n"))


def word_grams(words: DataFrame, cols: tuple[str, ...], ngram_range: tuple[int, int]) -> DataFrame:
    """(cols..., term): ``char_wb_ngrams`` of every ``_word``, by rows of lengths and places (generated code, no lambdas)."""
    lo, hi = ngram_range
    p = words.select(*cols, F.concat(F.lit(" "), "_word", F.lit(" ")).alias("_p")).withColumn("_l", F.length("_p"))
    # a word shorter than the smallest length has no n-gram
    p = p.filter(F.col("_l") >= lo).select("*", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("_l")))).alias("_k"))
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("_l") - F.col("_k") + 1)).alias("_i"))
    return p.select(*cols, F.substring("_p", F.col("_i"), F.col("_k")).alias("term"))


def term_counts(df: DataFrame, text_col: str, cfg: TfidfConfig, id_col: str = "row_id",
                keep: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """(id, keep..., term, tf): n-gram counts per row; with ``among`` (term) those of its terms alone.

    ``keep`` columns must be functionally dependent on the id (e.g. split).
    The texts are hash-partitioned by the id here, whatever the source: they move
    once, before the n-grams multiply them, and nothing below moves with them.
    """
    d = by_row(df, text_col, (id_col, *keep))
    if cfg.analyzer in ("word", "char_wb") and not df.isStreaming:
        small = among is not None and vocabulary_bytes(among) <= BROADCAST_LIMIT_BYTES
        counts = G.row_counts(d, [id_col, *keep], cfg.tokens(text_col), cfg.ngram_range, arrow_terms(among) if small else None, cfg.chars)
        return counts if among is None or small else only(counts, among)
    if cfg.analyzer == "char_wb":
        g = word_grams(counted_words(d, text_col, (id_col, *keep)), (id_col, *keep, "_n"), cfg.ngram_range)
        n = F.sum("_n")
    else:
        g = d.select(id_col, *keep, F.explode(cfg.ngrams(text_col)).alias("term"))
        n = F.count(F.lit(1))
    if among is not None:
        g = only(g, among)
    return g.groupBy(id_col, *keep, "term").agg(n.alias("tf"))


def arrow_terms(terms: DataFrame) -> pa.Array:
    """The different terms of a table that was measured to be small."""
    held = terms.select("term").distinct().toArrow().column("term")
    return pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], pa.string())


def term_statistics(df: DataFrame, text_col: str, cfg: TfidfConfig, id_col: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, df, ctf) over all rows."""
    if cfg.analyzer == "word":
        parts = text_partitions(df, text_col)
        d = by_row(df, text_col, (id_col, *keep), parts)
        # the terms of TERM_PARTS partitions of texts go to one task
        dealt = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(parts / TERM_PARTS))
        return G.term_totals(d, [id_col, *keep], cfg.tokens(text_col), cfg.ngram_range, dealt)
    if cfg.chars:
        return G.char_totals(by_row(df, text_col, (id_col, *keep)), [id_col, *keep], cfg.tokens(text_col), cfg.ngram_range)
    return term_counts(df, text_col, cfg, id_col, keep).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


# ---------------------------------------------------------------- term ids

class TermCollision(RuntimeError):
    """Two terms that share an id met in a vocabulary's candidates."""


def term_id(term, salt: int) -> Column:
    """A 64-bit id of a term."""
    return F.xxhash64(term, F.lit(salt))


def id_counts(df: DataFrame, text_col: str, cfg: TfidfConfig, id_col: str = "row_id", keep: tuple[str, ...] = (),
              salt: int = 0, parts: int | None = None) -> DataFrame:
    """(id, keep..., tid, tf): ``term_counts`` by term id."""
    d = by_row(df, text_col, (id_col, *keep), parts)
    counts = G.row_counts(d, [id_col, *keep], cfg.tokens(text_col), cfg.ngram_range, chars=cfg.chars)
    return counts.select(id_col, *keep, term_id("term", salt).alias("tid"), "tf")


@dataclass
class Terms:
    """Term counts by id: ``counts`` (id, keep..., tid, tf), written; ``source`` gives the terms (term)
    behind them, with repeats; ``again`` the same counts under another salt."""
    counts: DataFrame
    source: Callable[[], DataFrame]
    again: Callable[[int], "Terms"]
    salt: int = 0

    @staticmethod
    def of_texts(df: DataFrame, text_col: str, cfg: TfidfConfig, id_col: str = "row_id", keep: tuple[str, ...] = (),
                 salt: int = 0) -> Terms:
        if salt == 0:
            # composed once: the length, the counts and the terms' strings each read the texts
            df = materialize(df.select(*dict.fromkeys((id_col, *keep, text_col))), "texts")
        parts = text_partitions(df, text_col)

        def source() -> DataFrame:
            if cfg.analyzer != "char_wb":
                d = by_row(df, text_col, (id_col,), parts)
                return G.slice_totals(d, [id_col], word_tokens(text_col, cfg.mark_aware), cfg.ngram_range).select("term")
            return word_grams(df.select(F.explode(char_wb_words(text_col)).alias("_word")).distinct(), (), cfg.ngram_range)

        return Terms(materialize(id_counts(df, text_col, cfg, id_col, keep, salt, parts), "term-counts"), source,
                     lambda new: Terms.of_texts(df, text_col, cfg, id_col, keep, new), salt)

    @staticmethod
    def of_counts(tf: DataFrame, salt: int = 0) -> Terms:
        """From counts by term (row_id, term, tf)."""
        counts = tf.withColumn("tid", term_id("term", salt)).drop("term")
        return Terms(counts, lambda: tf.select("term"), lambda new: Terms.of_counts(tf, new), salt)

    def strings(self, ids: DataFrame) -> DataFrame:
        """(tid, term) for the ids in ``ids`` (tid), written; each id has one term, or ``TermCollision`` is raised."""
        pairs = only(self.source().select(term_id("term", self.salt).alias("tid"), "term"), ids, "tid").distinct()
        held = materialize(pairs, "term-strings")
        if not held.groupBy("tid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
            raise TermCollision(f"salt {self.salt}")
        return held


T_ = TypeVar("T_")


def without_collisions(terms: Terms, use: Callable[[Terms], T_], tries: int = 8) -> T_:
    """``use(terms)``, with ids drawn anew as long as two terms share one."""
    for salt in range(terms.salt, terms.salt + tries):
        try:
            return use(terms if salt == terms.salt else terms.again(salt))
        except TermCollision:
            continue
    raise TermCollision(f"terms still share ids after {tries} salts")


# ---------------------------------------------------------------- vocabulary

def idf_col(n_docs: Column, df_col: Column) -> Column:
    """Smoothed idf: ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


#: Counts below this have a bin of their own; beyond, 64 bins for each doubling.
EXACT_BINS = 1024


def _bin(count: Column) -> Column:
    """A number that rises with the count; some 4,000 different ones at most."""
    return F.when(count < EXACT_BINS, count).otherwise(EXACT_BINS + F.floor(F.log2(count / EXACT_BINS) * 64)).cast("long")


def above_boundary(df: DataFrame, k: int, count_col: str = "ctf", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and (_tie, _need), written: the rows that can be among the ``k`` largest of their group.

    A histogram of the counts (summed in the tasks first) finds the bin that the k-th row lies in.  Rows
    of higher bins are in; of those in the boundary bin (``_tie``) the first ``_need`` are.  No
    other row is written."""
    by = list(by)
    d = df.withColumn("_bin", _bin(F.col(count_col)))
    hist = d.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    falling = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)   # bins, not rows
    edges = hist.withColumn("_before", F.coalesce(F.sum("_n").over(falling), F.lit(0))).filter(F.col("_before") < k) \
        .groupBy(*[F.col(c).alias(f"_e_{c}") for c in by]).agg(F.min("_bin").alias("_edge"), F.max("_before").alias("_before"))
    if by:
        same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by]
        d = d.join(F.broadcast(edges), same)   # one row a group
    else:
        d = d.withColumns({"_edge": edges.select("_edge").scalar(), "_before": edges.select("_before").scalar()})
    kept = d.filter(F.col("_bin") >= F.col("_edge"))
    return materialize(kept.select(*df.columns, (F.col("_bin") == F.col("_edge")).alias("_tie"),
                                   (F.lit(k) - F.col("_before")).alias("_need")), "vocabulary-candidates")


def break_ties(held: DataFrame, count_col: str = "ctf", key: str = "term", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``above_boundary`` that are in: of the ties those first by count falling and ``key``.

    The ties alone are written again, range-partitioned by (group, count falling, key): whole
    partitions then lie in rank order, so a row's rank is its place in its partition plus
    the rows of its group in earlier partitions (one small count a partition and group)."""
    by = list(by)
    cols = [c for c in held.columns if c not in ("_tie", "_need")]
    order = [F.desc(count_col), F.asc(key)]
    ties = held.filter("_tie").repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id())
    ties = materialize(ties, "vocabulary-ties")
    sizes = ties.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a group and partition
    off = sizes.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_part").alias("_o_part"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = F.col("_part") == F.col("_o_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    first = ties.join(F.broadcast(off), same).filter(F.col("_off") < F.col("_need")).withColumn("_rank", F.col("_off") + place) \
        .filter(F.col("_rank") <= F.col("_need"))
    return held.filter(~F.col("_tie")).select(*cols).unionByName(first.select(*cols))


def top_k_by_count(df: DataFrame, k: int, count_col: str = "ctf", key: str = "term",
                   by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``count_col`` per ``by`` group, ties by
    ``key`` ascending -- exact, and without a single-task sort; at most k rows and those of the
    boundary bin are written."""
    return break_ties(above_boundary(df, k, count_col, by), count_col, key, by)


def vocabulary(terms: Terms, counts: DataFrame, n_docs: int, cfg: TfidfConfig) -> DataFrame:
    """``fit_vocabulary`` from the *fit* rows' counts by id: strings are looked up for the terms above the boundary and its ties."""
    v = counts.groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")).filter(F.col("df") >= cfg.min_df)
    held = materialize(v, "vocabulary-candidates") if cfg.max_features is None else above_boundary(v, cfg.max_features)
    named = held.join(terms.strings(held), "tid")
    idf = idf_col(F.lit(float(n_docs)), F.col("df")).alias("idf")
    if cfg.max_features is None:
        return alphabetical(named).select("term", "idx", "df", "ctf", idf)
    place = F.row_number().over(Window.orderBy("term"))   # at most max_features rows
    return break_ties(named).select("term", (place - 1).cast("long").alias("idx"), "df", "ctf", idf)


def fit_vocabulary(tf: DataFrame, n_docs: int, cfg: TfidfConfig) -> DataFrame:
    """(term, idx, df, ctf, idf) from the *fit* rows' term counts.

    Terms need ``df >= min_df``; of those the ``max_features`` with the largest
    total count are kept (ties by term).  ``idx`` is the term's alphabetical
    rank.  ``n_docs`` counts every fit row, token-less ones included.
    """
    return vocabulary_of(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")), n_docs, cfg)


def vocabulary_of(statistics: DataFrame, n_docs: int, cfg: TfidfConfig) -> DataFrame:
    """``fit_vocabulary`` from (term, df, ctf) over the fit rows."""
    v = statistics.filter(F.col("df") >= cfg.min_df)
    idf = idf_col(F.lit(float(n_docs)), F.col("df")).alias("idf")
    if cfg.max_features is not None:
        v = materialize(v, "term-statistics")   # read for the histogram and for the terms above its boundary
    if cfg.max_features is None:
        return alphabetical(v).select("term", "idx", "df", "ctf", idf)
    # at most max_features rows: ranking them in one window is bounded work
    place = F.row_number().over(Window.orderBy("term"))
    return top_k_by_count(v, cfg.max_features).select("term", (place - 1).cast("long").alias("idx"), "df", "ctf", idf)


def alphabetical(df: DataFrame, key: str = "term") -> DataFrame:
    """Adds ``idx``, the row's place by ``key`` (unique), for tables of any size: places inside
    range partitions plus the rows of the partitions before."""
    held = materialize(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranked-terms")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))   # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select(F.col("_part").alias("_o_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return held.join(F.broadcast(off), F.col("_part") == F.col("_o_part")) \
        .withColumn("idx", (F.col("_off") + place - 1).cast("long")).drop("_part", "_o_part", "_off")


def vocabulary_join(tf: DataFrame, vocab: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES, on: str = "term") -> DataFrame:
    """Inner join of term counts with the vocabulary, broadcasting the
    vocabulary only when its measured size is under ``limit_bytes``."""
    side = F.broadcast(vocab) if vocabulary_bytes(vocab) <= limit_bytes else vocab
    return tf.join(side, on)


def only(df: DataFrame, wanted: DataFrame, on: str = "term") -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``wanted``, which is broadcast only behind a measured size check."""
    w = wanted.select(F.col(on).alias("_wanted"))
    small = vocabulary_bytes(wanted) <= BROADCAST_LIMIT_BYTES
    return df.join(F.broadcast(w) if small else w, F.col(on) == F.col("_wanted"), "left_semi")


def vocabulary_bytes(vocab: DataFrame) -> int:
    """The measured size of a vocabulary as a broadcast."""
    return vocab.agg((F.sum((F.length("term") if "term" in vocab.columns else F.lit(0)) + F.lit(48))).alias("b")).first()["b"] or 0


def tfidf_weights(tf: DataFrame, vocab: DataFrame, id_col: str = "row_id",
                  sublinear_tf: bool = True, keep: tuple[str, ...] = (), salt: int = 0) -> DataFrame:
    """(id, keep..., term, idx, weight): (1 + ln tf) x idf, L2-normalised per row.

    Unseen terms drop out in the join; a row with no vocabulary term has no
    entries (its vector is all zeros)."""
    if "tid" in tf.columns:
        j = vocabulary_join(tf, vocab.withColumn("tid", term_id("term", salt)), on="tid")
    else:
        j = vocabulary_join(tf, vocab)
    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if sublinear_tf else F.col("tf").cast("double")
    raw = j.select(id_col, *keep, "term", "idx", (tfw * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, *keep, "term", "idx", (F.col("_w") / norm).alias("weight"))


def tfidf(df: DataFrame, text_col: str, cfg: TfidfConfig, fit_on: tuple[str, str] | None = None,
          id_col: str = "row_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Fit the vocabulary on rows where ``fit_on[0] == fit_on[1]`` (all rows
    if None) and weight every row -> (weights, vocabulary)."""
    # the counts of all terms feed the vocabulary and are not written: a second pass over the texts
    # counts the vocabulary's terms alone, in the rows' own partitions
    cols = tuple(dict.fromkeys([*keep, *([fit_on[0]] if fit_on else [])]))
    # the texts are composed once: their length, both passes and the number of rows read them
    df = materialize(df.select(*dict.fromkeys((id_col, *cols, text_col))), "texts")
    fit = df if fit_on is None else df.filter(F.col(fit_on[0]) == F.lit(fit_on[1]))
    vocab = materialize(vocabulary_of(term_statistics(fit, text_col, cfg, id_col, cols), fit.count(), cfg), "vocabulary")
    if vocabulary_bytes(vocab) <= BROADCAST_LIMIT_BYTES:
        small = vocab.select("term", "idx", "idf").toArrow()   # max_features rows
        return G.row_weights(by_row(df, text_col, (id_col, *cols)), [id_col, *cols], [id_col, *keep], cfg.tokens(text_col),
                             cfg.ngram_range, small, cfg.sublinear_tf, cfg.chars), vocab
    tf = term_counts(df, text_col, cfg, id_col, cols, among=vocab)
    return tfidf_weights(tf, vocab, id_col, cfg.sublinear_tf, keep=tuple(keep)), vocab


def tfidf_by_id(df: DataFrame, text_col: str, cfg: TfidfConfig, fit_on: tuple[str, str] | None = None,
                id_col: str = "row_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``tfidf`` on term ids: half the bytes in every table and shuffle, for a second pass over the texts."""
    cols = tuple(dict.fromkeys([*keep, *([fit_on[0]] if fit_on else [])]))
    cond = F.lit(True) if fit_on is None else F.col(fit_on[0]) == F.lit(fit_on[1])
    n_docs = df.filter(cond).count()

    def fit(terms: Terms) -> tuple[DataFrame, DataFrame]:
        vocab = materialize(vocabulary(terms, terms.counts.filter(cond), n_docs, cfg), "vocabulary")
        return tfidf_weights(terms.counts, vocab, id_col, cfg.sublinear_tf, tuple(keep), terms.salt), vocab

    # the counts feed both the vocabulary and the weights
    return without_collisions(Terms.of_texts(df, text_col, cfg, id_col, cols), fit)


def assemble_vectors(weights: DataFrame, id_col: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., indices array<int>, values array<double>) sorted by index:
    one sparse row per document, the input of the linear fits."""
    g = weights.groupBy(id_col, *keep).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"),
                                             F.col("weight").alias("v")))).alias("_e"))
    return g.select(id_col, *keep, F.col("_e.i").alias("indices"), F.col("_e.v").alias("values"))
