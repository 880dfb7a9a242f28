"""Baseline study: TF-IDF + class-balanced linear models on the official split.

Three models (char-LR, word-LR, word-SVM): vocabulary fitted on TRAIN, model
fitted on TRAIN, scored on TEST; 5-fold cross-validation on TRAIN refits the
vocabulary and the model in every fold.  The best model by F1-macro (first
wins ties) is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators import linear as L
from claimlens.operators import metrics as M
from claimlens.operators import models as MD
from claimlens.operators import reports as R
from claimlens.operators import splits as X
from claimlens.operators import tfidf as T
from claimlens.operators.certificate import certificate
from claimlens.session import materialize
from claimlens.sources import files

# The reference's three baselines, in its order.
BASELINES = [
    ("tfidf_char_lr", "TF-IDF (char) + LR", T.CHAR, L.LOGREG),
    ("tfidf_word_lr", "TF-IDF (word) + LR", T.WORD, L.LOGREG),
    ("tfidf_svm", "TF-IDF + LinearSVC", T.WORD, L.SVM),
]


@dataclass
class FittedModel:
    vocab: DataFrame
    coef: DataFrame
    intercept: float
    info: dict
    spec: L.LinearSpec
    cfg: T.TfidfConfig


def fit_text_model(claims: DataFrame, cfg: T.TfidfConfig, spec: L.LinearSpec,
                   text_col: str = "text_concat") -> tuple[FittedModel, DataFrame]:
    """Fit on TRAIN; return the model and (row_id, data_type, label, margin, prob, prediction) for all rows."""
    spark = claims.sparkSession
    weights, vocab = T.tfidf(claims, text_col, cfg, fit_on=("data_type", "TRAIN"))
    d = vocab.count()
    # weights feed the fit and the scoring: written once to shared storage
    weights = materialize(weights.select("row_id", "idx", "weight"), "weights")
    rows = materialize(claims.select("row_id", "data_type", "label"), "rows")
    vec = MD.with_vectors(rows, weights)
    w, info = MD.fit(vec.filter(F.col("data_type") == "TRAIN"), d, spec)
    coef = materialize(MD.coefficient_table(spark, w, vocab), "coefficients")
    preds = MD.predict(weights, rows, coef, float(w[-1]), spec)
    return FittedModel(vocab, coef, float(w[-1]), info, spec, cfg), preds


def evaluate_test(preds: DataFrame, spec: L.LinearSpec) -> DataFrame:
    test = preds.filter(F.col("data_type") == "TEST")
    return M.evaluate(test, score="prob" if spec.loss == "logistic" else None)


def model_certificate(claims: DataFrame, model: FittedModel, text_col: str = "text_concat") -> DataFrame:
    """How close a fitted model is to the best one on TRAIN, from texts, labels and coefficients alone."""
    train = claims.filter(F.col("data_type") == "TRAIN")
    run = F.lit(0).cast("long").alias("run")
    coef = model.vocab.select("term", "idf").join(model.coef.select("term", "coef"), "term").select(run, "term", "idf", "coef")
    spark = claims.sparkSession
    coef = coef.unionByName(spark.createDataFrame([(0, None, 1.0, model.intercept)], "run long, term string, idf double, coef double"))
    tf = T.term_counts(train, text_col, model.cfg, among=model.vocab)   # other terms have no coefficient
    return certificate(tf, train.select(run, "row_id", "label"), coef, model.spec, model.cfg.sublinear_tf)


def cross_val_certificates(train: DataFrame, cfg: T.TfidfConfig, spec: L.LinearSpec, k: int = 5, seed: int = 42,
                           text_col: str = "text_concat") -> DataFrame:
    """``model_certificate`` of every fold's model."""
    rows = materialize(train.select("row_id", "label"), "rows")
    roles = fold_roles(rows, k, seed)
    _, fitted = MD.fit_and_score(T.Terms.of_texts(train, text_col, cfg), rows, roles, cfg, spec)
    held = materialize(fitted.coefficients(), "run-coefficients")
    used = materialize(held.filter("term IS NOT NULL").select("term").distinct(), "used-terms")
    tf = materialize(T.term_counts(train, text_col, cfg, among=used), "term-counts")   # each fold reads them
    return certificate(tf, roles.train().join(rows, "row_id"), held, spec, cfg.sublinear_tf)


def fold_assignments(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(run, row_id, role): run f trains on the other folds and tests on fold f."""
    folds = X.stratified_kfold(df, k=k, seed=seed)
    r = folds.select("row_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("run"))
    return r.select(F.col("run").cast("long").alias("run"), "row_id",
                    F.when(F.col("fold") == F.col("run"), F.lit("test")).otherwise(F.lit("train")).alias("role"))


def fold_roles(df: DataFrame, k: int = 5, seed: int = 42) -> MD.Roles:
    """Run f trains on the other folds and tests on fold f: one row a row, one digit a fold."""
    folds = X.stratified_kfold(df, k=k, seed=seed)
    digits = F.concat(F.repeat(F.lit("1"), F.col("fold")), F.lit("2"), F.repeat(F.lit("1"), k - 1 - F.col("fold")))
    return MD.Roles(folds.select("row_id", digits.alias("roles")), list(range(k)), True)


def run_scores(preds: DataFrame) -> DataFrame:
    """(run, n, f1_macro, ...) from fit_many output."""
    return M.with_f1_metrics(M.confusion_counts(preds, by=["run"]))


def cross_val_scores(train: DataFrame, cfg: T.TfidfConfig, spec: L.LinearSpec, k: int = 5, seed: int = 42,
                     text_col: str = "text_concat") -> DataFrame:
    """M6: per-fold F1-macro with vocabulary and model refitted in each fold."""
    preds, _ = cross_val_runs(train, cfg, spec, k, seed, text_col)
    return run_scores(preds).select("run", "n", "f1_macro")


def cross_val_runs(train: DataFrame, cfg: T.TfidfConfig, spec: L.LinearSpec, k: int = 5, seed: int = 42,
                   text_col: str = "text_concat") -> tuple[DataFrame, DataFrame]:
    """The scored held-out rows of every fold, and how each fold's fit ended."""
    tf = T.Terms.of_texts(train, text_col, cfg)
    rows = materialize(train.select("row_id", "label"), "rows")
    return MD.fit_many(tf, rows, fold_roles(rows, k, seed), cfg, spec)


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1_macro").alias("cv_f1_mean"), F.stddev_pop("f1_macro").alias("cv_f1_std"))


def run_baselines(claims: DataFrame, text_col: str = "text_concat", with_cv: bool = True,
                  models=BASELINES) -> DataFrame:
    """One metric row per baseline (+ CV mean/std), with ``position``."""
    return fit_baselines(claims, text_col, with_cv, models)[0]


def fit_baselines(claims: DataFrame, text_col: str = "text_concat", with_cv: bool = True,
                  models=BASELINES) -> tuple[DataFrame, dict[str, FittedModel]]:
    """M10 with the fitted models kept, by key: the metric rows of ``run_baselines`` and the models.

    The char model's record lists its 10 most MANI-predictive n-grams."""
    train = claims.filter(F.col("data_type") == "TRAIN")
    rows, fitted = [], {}
    for pos, (key, name, cfg, spec) in enumerate(models):
        fitted[key], preds = fit_text_model(claims, cfg, spec, text_col)
        e = evaluate_test(preds, spec).select(F.lit(key).alias("key"), F.lit(name).alias("model"),
                                              F.lit(pos).alias("position"), "*")
        top = F.lit(None).cast("array<string>")
        if key == "tfidf_char_lr":
            best = MD.top_features(fitted[key].coef, 10).filter(F.col("direction") == "MANI")
            top = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])).scalar()
        e = e.withColumn("top_mani_features", top)
        if with_cv:
            # the CV summary is one row of two numbers
            cv = cv_summary(cross_val_scores(train, cfg, spec, text_col=text_col)).first()
            e = e.withColumns({c: F.lit(v).cast("double") for c, v in cv.asDict().items()})
        rows.append(e)
    return R.union_all(rows), fitted


def save_best(results: DataFrame, fitted: dict[str, FittedModel], path: str) -> str:
    """Save the best baseline as tables and return its key."""
    key = best_baseline(results).select("key").first()[0]
    m = fitted[key]
    files.save_model(path, m.vocab, m.coef, m.intercept, {"key": key, "loss": m.spec.loss, "analyzer": m.cfg.analyzer,
                                                        "ngram_range": list(m.cfg.ngram_range), "sublinear_tf": m.cfg.sublinear_tf})
    return key


def score_saved(spark, path: str, rows: DataFrame, text_col: str = "text_concat") -> DataFrame:
    """``rows`` (row_id, text) + (margin, prob, prediction) by a saved model."""
    vocab, coef, meta = files.load_model(spark, path)
    cfg = T.TfidfConfig(meta["analyzer"], tuple(meta["ngram_range"]), None, sublinear_tf=meta["sublinear_tf"])
    weights = T.tfidf_weights(T.term_counts(rows, text_col, cfg), vocab, sublinear_tf=cfg.sublinear_tf)
    return MD.predict(weights, rows.select("row_id"), coef, meta["intercept"], L.LinearSpec(meta["loss"], 1.0))


def best_baseline(results: DataFrame) -> DataFrame:
    """Highest F1-macro, first model wins ties."""
    return R.best_by(results, "f1_macro", "position")
