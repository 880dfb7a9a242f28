"""Fitting and applying the linear classifiers on TF-IDF tables.

* ``fit``/``predict`` - one model: vectors -> coefficients -> scores;
* ``fit_many`` - many runs (folds, seeds, holdouts) from ONE shared term-count
  table: per-run vocabularies, idf and norms are grouped aggregates keyed by
  run; the rows are packed once over the union of the vocabularies, and all
  runs are fitted together by the distributed optimiser (``linear.fit_runs``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.operators import linear as L
from claimlens.operators import tfidf as TF
from claimlens.session import materialize


class NotConverged(RuntimeError):
    """A fit stopped before its gradient vanished."""


def with_vectors(rows: DataFrame, weights: DataFrame, keys=("row_id",)) -> DataFrame:
    """rows + (indices, values); rows without any vocabulary term get empty arrays."""
    keys = list(keys)
    vec = TF.assemble_vectors(weights, id_col=keys[-1], keep=tuple(keys[:-1]))
    j = rows.join(vec, keys, "left")
    return j.select(*rows.columns,
                    F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
                    F.coalesce("values", F.array().cast("array<double>")).alias("values"))


def _require(infos: Sequence[dict], strict: bool) -> None:
    bad = [i for i, x in enumerate(infos) if not x["converged"]]
    if bad and strict:
        raise NotConverged(f"runs {bad} of {len(infos)} did not converge: {[infos[i] for i in bad[:3]]}")


def fit(train_vectors: DataFrame, d: int, spec: L.LinearSpec, label: str = "label", strict: bool = True):
    """-> (weights ndarray of d + 1, info), info with iterations, passes, grad_max and converged.

    Raises ``NotConverged`` unless ``strict`` is false.  Without training rows the weights are zero."""
    role = F.lit(str(L.TRAIN))
    rows = train_vectors.select(F.lit(0).cast("long").alias("row_id"), F.col(label).cast("int").alias("label"),
                                "indices", "values", role.alias("roles"))
    blocks = L.pack(rows, 1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if blocks.isEmpty():
            return np.zeros(d + 1), {"n_train": 0, "iterations": 0, "passes": 0, "grad_max": 0.0, "objective": 0.0, "converged": True}
        w, infos = L.fit_runs(blocks, 1, d, spec)
    finally:
        blocks.unpersist()
    _require(infos, strict)
    return w[0], infos[0]


def coefficient_table(spark, w: np.ndarray, vocab: DataFrame) -> DataFrame:
    """(term, idx, coef): the model as a table (vocabulary-sized)."""
    coef = spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(w) - 1, dtype=np.int64), "coef": w[:-1]}))
    return vocab.select("term", "idx").join(coef, "idx")


def predict(weights: DataFrame, rows: DataFrame, coef: DataFrame, intercept: float,
            spec: L.LinearSpec, id_col: str = "row_id") -> DataFrame:
    """rows + (margin, prob, prediction).  ``prob`` is NULL for the SVM.
    The coefficient table is vocabulary-sized; it is broadcast only when its rows fit the limit."""
    small = coef.select("idx", "coef")
    if small.count() * 32 <= TF.BROADCAST_LIMIT_BYTES:
        small = F.broadcast(small)
    dot = weights.join(small, "idx") \
        .groupBy(id_col).agg(F.sum(F.col("weight") * F.col("coef")).alias("_dot"))
    m = rows.join(dot, id_col, "left").withColumn(
        "margin", F.coalesce("_dot", F.lit(0.0)) + F.lit(float(intercept))).drop("_dot")
    prob = (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))) if spec.loss == "logistic" \
        else F.lit(None).cast("double")
    return m.withColumn("prob", prob).withColumn("prediction", (F.col("margin") > 0).cast("int"))


def top_features(coef: DataFrame, k: int = 20, digits: int = 4) -> DataFrame:
    """(direction, rank, term, coef): the k largest and k smallest coefficients."""
    hi = coef.orderBy(F.desc("coef"), F.asc("term")).limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("coef"), F.asc("term"))))
    lo = coef.orderBy(F.asc("coef"), F.asc("term")).limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.asc("coef"), F.asc("term"))))
    return hi.select(F.lit("MANI").alias("direction"), "rank", "term", F.round("coef", digits).alias("coef")) \
        .unionByName(lo.select(F.lit("NO_MANI").alias("direction"), "rank", "term",
                               F.round("coef", digits).alias("coef")))


@dataclass
class Roles:
    """What every run does with every row: ``rows`` (row_id, roles) has one digit a run, in the order of
    ``runs`` (0: not used, 1: train, 2: test).  ``shared``: every run uses every row of one row set."""
    rows: DataFrame
    runs: list[int]
    shared: bool

    def _listed(self, role: int) -> DataFrame:
        numbers = F.array(*[F.lit(r).cast("long") for r in self.runs])
        digits = F.transform(F.split("roles", ""), lambda x, i: F.struct(F.get(numbers, i).alias("run"), x.alias("role")))
        return self.rows.select("row_id", F.explode(F.filter(digits, lambda x: x["role"] == str(role))).alias("x")).select("x.run", "row_id")

    def test(self) -> DataFrame:
        """(run, row_id) of the test rows; of runs that share their rows only these are ever listed."""
        return self._listed(L.TEST)

    def train(self) -> DataFrame:
        """(run, row_id) of the training rows."""
        return self._listed(L.TRAIN)

    def train_rows(self) -> DataFrame:
        """(run, n): training rows of each run."""
        sums = self.rows.agg(*[F.sum((F.substring("roles", i + 1, 1) == str(L.TRAIN)).cast("long")).alias(str(i)) for i in range(len(self.runs))])
        pairs = F.array(*[F.struct(F.lit(r).cast("long").alias("run"), F.col(str(i)).alias("_n")) for i, r in enumerate(self.runs)])
        return sums.select(F.explode(pairs).alias("x")).select("x.run", "x._n")

    @staticmethod
    def of(assign: DataFrame, shared: bool) -> Roles:
        """From one row a run and row: (run, row_id, role)."""
        runs = sorted(int(r[0]) for r in assign.select("run").distinct().collect())
        number = F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(r).cast("long"), F.lit(i))]) if runs else F.lit(None)
        used = F.map_from_entries(F.collect_list(F.struct(
            F.element_at(number, F.col("run").cast("long")).alias("i"),
            F.when(F.col("role") == "train", str(L.TRAIN)).otherwise(str(L.TEST)).alias("role"))))
        digits = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(runs) - 1))), lambda i: F.coalesce(F.try_element_at(F.col("used"), i), F.lit("0")))
        return Roles(assign.groupBy("row_id").agg(used.alias("used")).select("row_id", F.array_join(digits, "").alias("roles")), runs, shared)


def run_term_stats(tf: DataFrame, roles: Roles, cfg: TF.TfidfConfig, key: str = "term", cand: DataFrame | None = None) -> DataFrame:
    """(run, key..., df, ctf) over each run's training rows, df >= min_df.

    Where the runs share one row set, as folds and holdouts do, a run's training counts are the
    counts over all rows minus those of its held-out rows: only the held-out side (a fifth of
    the rows per run) is joined with the term table, and the all-row counts are aggregated
    once.  Otherwise each run's training rows are joined directly.  ``cand``: the all-row counts
    (key, more columns, _df, _ctf), if they are at hand; their further columns are kept."""
    cand = all_row_counts(tf, roles, cfg, key) if cand is None else cand
    more = [c for c in cand.columns if c not in (key, "_df", "_ctf")]
    if not roles.shared:
        st = tf.join(roles.train(), "row_id").groupBy("run", key) \
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")).filter(F.col("df") >= cfg.min_df)
        return st.join(cand.select(key, *more), key).select("run", key, *more, "df", "ctf") if more else st
    held = tf.join(roles.test(), "row_id").groupBy("run", key).agg(F.count(F.lit(1)).alias("_dfo"), F.sum("tf").alias("_ctfo"))
    cand = cand.select("*", F.explode(F.array(*[F.lit(r).cast("long") for r in roles.runs])).alias("run"))
    return cand.join(held, ["run", key], "left").select(
        "run", key, *more, (F.col("_df") - F.coalesce("_dfo", F.lit(0))).alias("df"),
        (F.col("_ctf") - F.coalesce("_ctfo", F.lit(0))).alias("ctf")).filter(F.col("df") >= cfg.min_df)


def all_row_counts(tf: DataFrame, roles: Roles, cfg: TF.TfidfConfig, key: str) -> DataFrame:
    """(key, _df, _ctf) over the rows of any run; a run's training df is at most this one, so no other term is a candidate."""
    return tf.join(roles.rows.select("row_id"), "row_id", "left_semi").groupBy(key) \
        .agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_ctf")).filter(F.col("_df") >= cfg.min_df)


def run_vocabularies(tf: DataFrame, assign: DataFrame | Roles, cfg: TF.TfidfConfig, shared_rows: bool = False) -> DataFrame:
    """(run, term, idx, idf): each run's vocabulary and idf from its training rows."""
    roles = assign if isinstance(assign, Roles) else Roles.of(assign, shared_rows)
    st = run_term_stats(tf, roles, cfg)
    if cfg.max_features is not None:
        st = TF.top_k_by_count(st, cfg.max_features, by=("run",))
    alpha = Window.partitionBy("run").orderBy("term")   # at most max_features rows per run
    return st.join(F.broadcast(roles.train_rows()), "run").select(
        "run", "term", (F.row_number().over(alpha) - 1).cast("long").alias("idx"),
        TF.idf_col(F.col("_n").cast("double"), F.col("df")).alias("idf"))


def run_term_ids(terms: TF.Terms, roles: Roles, cfg: TF.TfidfConfig) -> tuple[DataFrame, DataFrame, TF.Terms]:
    """((run, tid, place, idf) of each run's vocabulary, (tid, term, place) of all candidates, the terms left), written.

    ``place`` is the term's alphabetical rank among the candidates, by which ties are broken:
    the runs' own work is on longs."""
    cand, known = materialize(all_row_counts(terms.counts, roles, cfg, "tid"), "run-terms"), None
    if cfg.max_features is not None and roles.shared:
        terms, cand, known = possible_terms(terms, roles, cfg, cand)
    names = TF.alphabetical(terms.strings(cand)).select("tid", "term", F.col("idx").alias("place"))
    names = materialize(names, "candidate-terms")
    if known is None:
        st = run_term_stats(terms.counts, roles, cfg, "tid", cand.join(names.select("tid", "place"), "tid"))
    else:
        st = known.join(names.select("tid", "place"), "tid").select("run", "tid", "place", "df", "ctf")
    if cfg.max_features is not None:
        st = TF.top_k_by_count(st, cfg.max_features, key="place", by=("run",))
    voc = st.join(F.broadcast(roles.train_rows()), "run").select(
        "run", "tid", "place", TF.idf_col(F.col("_n").cast("double"), F.col("df")).alias("idf"))
    return materialize(voc, "run-vocabularies"), names, terms


def possible_terms(terms: TF.Terms, roles: Roles, cfg: TF.TfidfConfig, cand: DataFrame) -> tuple[TF.Terms, DataFrame, DataFrame | None]:
    """``terms`` and ``cand`` without those that no run's vocabulary can hold; no term of a vocabulary is lost.  Beside
    them the runs' counts (run, tid, df, ctf) of at least the terms left, or None if those are not at hand.

    A run's count of a term is at most the all-row count, and the run's k-th largest count is at
    least the k-th largest among any of its terms.  So the runs' counts of the 2 k most frequent terms alone
    give a bound: a term whose all-row count lies below every run's k-th count among those is in no vocabulary.
    Mostly all terms left are among the 2 k, and their counts in the runs are known then."""
    k = cfg.max_features
    top = materialize(TF.top_k_by_count(cand, 2 * k, "_ctf", key="tid"), "frequent-terms")
    counts = materialize(TF.only(terms.counts, top, "tid"), "frequent-counts")
    known = materialize(run_term_stats(counts, roles, cfg, "tid", top).select("run", "tid", "df", "ctf"), "frequent-run-counts")
    # at most 2 k rows a run
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ctf")))
    kth = known.select("ctf", place.alias("_place")).filter(F.col("_place") == k)
    found = kth.agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("least")).first()
    if found["n"] < len(roles.runs):   # some run has fewer than k of them: any term may be in its vocabulary
        everything = cand.count() <= 2 * k
        return terms, cand, known if everything else None
    kept = materialize(cand.filter(F.col("_ctf") >= found["least"]), "possible-terms")
    inside = kept.count() <= 2 * k   # then they are all among the 2 k most frequent
    left = TF.only(counts if inside else terms.counts, kept, "tid")
    return replace(terms, counts=materialize(left, "possible-counts")), kept, known if inside else None


def run_vectors(tf: DataFrame, rows: DataFrame, assign: DataFrame, cfg: TF.TfidfConfig,
                voc: DataFrame | None = None) -> DataFrame:
    """(run, row_id, role, label, d, indices, values) with a vocabulary and idf
    refitted on each run's training rows; term counts are computed once.
    Fully relational: (run, row, term) rows are joined with the run
    vocabularies, so no run has to fit in one task."""
    voc = run_vocabularies(tf, assign, cfg) if voc is None else voc
    dsize = voc.groupBy("run").agg(F.count(F.lit(1)).alias("d"))
    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if cfg.sublinear_tf else F.col("tf").cast("double")
    raw = tf.join(assign.select("run", "row_id"), "row_id").join(voc, ["run", "term"]) \
        .select("run", "row_id", "idx", (tfw * F.col("idf")).alias("_w"))
    nrm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("run", "row_id")))
    w = raw.select("run", "row_id", "idx", (F.col("_w") / nrm).alias("weight"))
    base = assign.join(rows.select("row_id", "label"), "row_id").join(F.broadcast(dsize), "run", "left") \
        .withColumn("d", F.coalesce("d", F.lit(0)))
    return with_vectors(base, w, keys=("run", "row_id"))


RUN_OUT = "run long, row_id long, label int, margin double, prob double, prediction int"
RUN_INFO = "run long, n_train long, n_features long, iterations int, passes int, grad_max double, converged boolean"


def _scores(weights: np.ndarray, idf: np.ndarray, run_ids: list[int], logistic: bool, spark):
    shipped = spark.sparkContext.broadcast((weights[:, :-1] * idf, weights[:, -1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, b = shipped.value
        for block in L.blocks_of(batches, len(run_ids)):
            for r, run_id in enumerate(run_ids):
                at = np.flatnonzero(block.roles[:, r] == L.TEST)
                if len(at):
                    z = block.margins(r, u[r], b[r])[at]
                    prob = pa.array(L.sigmoid(z)) if logistic else pa.nulls(len(at), pa.float64())
                    yield pa.record_batch([pa.array(np.full(len(at), run_id)), pa.array(block.ids[at]),
                                           pa.array((block.y[at] > 0).astype(np.int32)), pa.array(z), prob,
                                           pa.array((z > 0).astype(np.int32))],
                                          names=["run", "row_id", "label", "margin", "prob", "prediction"])

    return run


@dataclass
class FittedRuns:
    """The models of many runs: ``vocabulary`` (run, term, idf, gidx), weights (runs x features by gidx, intercepts last)."""
    vocabulary: DataFrame
    weights: np.ndarray
    idf: np.ndarray
    runs: list[int]
    info: DataFrame

    def coefficients(self) -> DataFrame:
        """(run, term, idf, coef) of the normalised rows, and each run's intercept under a null term."""
        spark = self.vocabulary.sparkSession
        # runs x vocabulary rows, which the driver holds already; written as one array a run
        rows = [(int(r), w[:-1].tobytes(), float(w[-1])) for r, w in zip(self.runs, self.weights)]

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for run, raw, intercept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    w = np.frombuffer(raw, dtype="<f8")
                    yield pa.record_batch([pa.array(np.full(len(w) + 1, run)), pa.array([None, *range(len(w))], pa.int32()),
                                           pa.array(np.append(intercept, w))], names=["c_run", "c_gidx", "coef"])

        coef = spark.createDataFrame(rows, "run long, w binary, b double").repartition(max(1, min(len(rows), 64)), "run") \
            .mapInArrow(spread, "c_run long, c_gidx int, coef double")
        voc = self.vocabulary
        terms = voc.join(coef, (F.col("run") == F.col("c_run")) & (F.col("gidx") == F.col("c_gidx"))).select("run", "term", "idf", "coef")
        return terms.unionByName(coef.filter("c_gidx IS NULL").select(
            F.col("c_run").alias("run"), F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("idf"), "coef"))


def fit_many(tf: DataFrame | TF.Terms, rows: DataFrame, assign: DataFrame | Roles, cfg: TF.TfidfConfig, spec: L.LinearSpec,
             shared_rows: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fit one model per run on its 'train' rows and score its 'test' rows, from shared term counts.

    -> ((run, row_id, label, margin, prob, prediction), (run, n_train, n_features, iterations, passes,
    grad_max, converged)).  Raises ``NotConverged`` unless ``strict`` is false."""
    preds, fitted = fit_and_score(tf, rows, assign, cfg, spec, shared_rows, strict)
    return preds, fitted.info


def fit_and_score(tf: DataFrame | TF.Terms, rows: DataFrame, assign: DataFrame | Roles, cfg: TF.TfidfConfig, spec: L.LinearSpec,
                  shared_rows: bool = False, strict: bool = True) -> tuple[DataFrame, FittedRuns]:
    """``fit_many`` with the fitted models kept.

    A row's term counts are packed once, over the union of the runs' vocabularies; a run
    adds its role (a digit), its idf vector (zero outside its vocabulary) and the row's norm."""
    roles = assign if isinstance(assign, Roles) else Roles.of(assign, shared_rows)
    roles = Roles(materialize(roles.rows, "roles"), roles.runs, roles.shared)
    terms = tf if isinstance(tf, TF.Terms) else TF.Terms.of_counts(tf)
    return TF.without_collisions(terms, lambda t: _fit_and_score(t, rows, roles, cfg, spec, strict))


def _fit_and_score(terms: TF.Terms, rows: DataFrame, roles: Roles, cfg: TF.TfidfConfig, spec: L.LinearSpec,
                   strict: bool) -> tuple[DataFrame, FittedRuns]:
    spark = rows.sparkSession
    voc, names, terms = run_term_ids(terms, roles, cfg)
    union = materialize(TF.alphabetical(voc.select("tid", "place").distinct(), "place").select("tid", F.col("idx").cast("int").alias("gidx")),
                        "union-vocabulary")
    number = {r: i for i, r in enumerate(roles.runs)}
    n, d = len(roles.runs), union.count()
    if n * (d + 1) * L.HELD > L.MAX_WEIGHTS:
        raise ValueError(f"{n} runs x {d} features exceed MAX_WEIGHTS; fit fewer runs at once or bound max_features")
    numbered = voc.join(union, "tid")
    idf = np.zeros((n, d))
    for batch in numbered.select("run", "gidx", "idf").toArrow().to_batches():
        run_of = np.array([number[r] for r in batch.column(0).to_pylist()], dtype=np.int64)
        idf[run_of, batch.column(1).to_numpy()] = batch.column(2).to_numpy()

    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if cfg.sublinear_tf else F.col("tf").cast("double")
    entries = TF.vocabulary_join(terms.counts, union, on="tid").select("row_id", "gidx", tfw.alias("_w")).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("gidx", "_w"))).alias("_e"))
    packed = rows.select("row_id", F.col("label").cast("int").alias("label")).join(roles.rows, "row_id").join(entries, "row_id", "left") \
        .select("row_id", "label", F.coalesce(F.col("_e.gidx"), F.array().cast("array<int>")).alias("indices"),
                F.coalesce(F.col("_e._w"), F.array().cast("array<double>")).alias("values"), "roles")
    blocks = L.pack(packed, n, idf).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights, infos = L.fit_runs(blocks, n, d, spec, idf)
        preds = materialize(blocks.mapInArrow(_scores(weights, idf, roles.runs, spec.loss == "logistic", spark), RUN_OUT), "run-scores")
    finally:
        blocks.unpersist()
    _require(infos, strict)
    info = spark.createDataFrame([(r, x["n_train"], int((idf[i] != 0).sum()), x["iterations"], x["passes"], x["grad_max"], x["converged"])
                                  for i, (r, x) in enumerate(zip(roles.runs, infos))], RUN_INFO)
    named = numbered.join(names.select("tid", "term"), "tid").select("run", "term", "idf", "gidx")
    return preds, FittedRuns(named, weights, idf, roles.runs, info)
