"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator,
and the DuckDB SQL that computes the same result independently.

Output columns carry the same names in both.  Doubles that come out of
order-dependent floating sums (means, norms) are rounded to 12 decimals in
both engines so the comparison is about the computation, not the summation
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import metrics as M
from claimlens.plans import oracle_sql as Q
from claimlens.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _pred(df: DataFrame, t: float = M.DEFAULT_THRESHOLD) -> DataFrame:
    return df.withColumn("prediction", M.apply_threshold("score", t))


def _matrix_text(df: DataFrame) -> DataFrame:
    """The nested matrix as JSON text, which SQL can spell too."""
    return df.withColumn("confusion_matrix", F.to_json("confusion_matrix"))


# ---------------------------------------------------------------- sources / projections

ENRICHED_COLS = ["row_id", "data_type", "label", "text_sep_token", "text_concat", "text_claim_only",
                 "text_excerpt", "claim_len", "article_len", "has_excerpt"]


@register("claims_enriched", Q.with_base("SELECT " + ", ".join(ENRICHED_COLS) + " FROM enriched"))
def q_claims_enriched(spark, sf_dir):
    """S1 + P1-P7: load, label, clean, compose, length features."""
    return S.claims(spark, sf_dir).select(*ENRICHED_COLS)


@register("split_distribution", Q.with_base(
    """SELECT data_type AS split, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
       round(avg(CAST(label AS DOUBLE)) * 100.0, 12) AS pos_pct
FROM enriched GROUP BY data_type"""))
def q_split_distribution(spark, sf_dir):
    """A1: rows, positives, negatives and positive share per split."""
    d = M.split_distribution(S.claims(spark, sf_dir))
    return d.withColumn("pos_pct", F.round("pos_pct", 12))


@register("class_weights", Q.with_base(
    """SELECT label, CAST(count(*) AS BIGINT) AS n,
       CAST((SELECT count(*) FROM enriched WHERE data_type = 'TRAIN') AS DOUBLE)
         / ((SELECT count(DISTINCT label) FROM enriched WHERE data_type = 'TRAIN') * count(*)) AS weight
FROM enriched WHERE data_type = 'TRAIN' GROUP BY label"""))
def q_class_weights(spark, sf_dir):
    """A2: balanced class weights of the training split."""
    return M.class_weights(S.claims(spark, sf_dir).filter(F.col("data_type") == "TRAIN"))


@register("class_weights_binary", Q.with_base(
    """SELECT label, n, CAST(total AS DOUBLE) / (2.0 * n) AS weight FROM (
  SELECT 0 AS label, CAST(sum(1 - label) AS BIGINT) AS n, count(*) AS total FROM enriched WHERE data_type = 'TRAIN'
  UNION ALL
  SELECT 1, CAST(sum(label) AS BIGINT), count(*) FROM enriched WHERE data_type = 'TRAIN')"""))
def q_class_weights_binary(spark, sf_dir):
    """A3: n / (2 x count) for the two classes, in label order."""
    return M.class_weights_binary(S.claims(spark, sf_dir).filter(F.col("data_type") == "TRAIN"))


# ---------------------------------------------------------------- metrics on the scored view

@register("confusion_matrix", Q.with_base(
    """SELECT y.label, p.prediction,
       CAST(count(s.row_id) AS BIGINT) AS n
FROM (VALUES (0), (1)) y(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
LEFT JOIN scored s ON s.label = y.label AND CAST(s.score > 0.5 AS INTEGER) = p.prediction
GROUP BY y.label, p.prediction""", scored=True))
def q_confusion_matrix(spark, sf_dir):
    """A4: the 2x2 matrix at threshold 0.5, zero cells included."""
    return M.confusion_matrix(_pred(S.scored(spark, sf_dir)))


@register("evaluate", Q.with_base(
    f"""SELECT c.*, {Q.METRICS}, {Q.MATRIX}, a.roc_auc FROM ({Q.counts('scored', 'CAST(score > 0.5 AS INTEGER)')}) c
CROSS JOIN auc a""", Q.auc_cte("auc", "scored"), scored=True))
def q_evaluate(spark, sf_dir):
    """One metric row for the whole scored table."""
    return _matrix_text(M.evaluate(_pred(S.scored(spark, sf_dir)), score="score"))


@register("evaluate_by_split", Q.with_base(
    f"""SELECT c.*, {Q.METRICS}, {Q.MATRIX}, a.roc_auc
FROM ({Q.counts('scored', 'CAST(score > 0.5 AS INTEGER)', 'data_type')}) c
LEFT JOIN auc a USING (data_type)""", Q.auc_cte("auc", "scored", "data_type"), scored=True))
def q_evaluate_by_split(spark, sf_dir):
    """A11 grouped: one metric row per split (the per-model form)."""
    return _matrix_text(M.evaluate(_pred(S.scored(spark, sf_dir)), score="score", by=["data_type"]))


@register("roc_auc", Q.with_base("SELECT * FROM auc", Q.auc_cte("auc", "scored"), scored=True))
def q_roc_auc(spark, sf_dir):
    """A10: tie-aware ROC-AUC of the scores."""
    return M.roc_auc(S.scored(spark, sf_dir))


_REPORT_SQL = Q.with_base(
    f"""SELECT * FROM (
  SELECT 'NO_MANI' AS class, {Q.ratio('tn', 'tn + fn')} AS precision, {Q.ratio('tn', 'tn + fp')} AS recall,
         {Q.F1_NEG} AS f1, tn + fp AS support FROM c
  UNION ALL
  SELECT 'MANI', {Q.ratio('tp', 'tp + fp')}, {Q.ratio('tp', 'tp + fn')}, {Q.F1_POS}, tp + fn FROM c
  UNION ALL
  SELECT 'accuracy', {Q.ACCURACY}, {Q.ACCURACY}, {Q.ACCURACY}, n FROM c
  UNION ALL
  SELECT 'macro avg', ({Q.ratio('tn', 'tn + fn')} + {Q.ratio('tp', 'tp + fp')}) / 2,
         ({Q.ratio('tn', 'tn + fp')} + {Q.ratio('tp', 'tp + fn')}) / 2, ({Q.F1_NEG} + {Q.F1_POS}) / 2, n FROM c
  UNION ALL
  SELECT 'weighted avg',
    CASE WHEN n > 0 THEN (CAST(tn + fp AS DOUBLE) * {Q.ratio('tn', 'tn + fn')} + CAST(tp + fn AS DOUBLE) * {Q.ratio('tp', 'tp + fp')}) / CAST(n AS DOUBLE) ELSE 0.0 END,
    CASE WHEN n > 0 THEN (CAST(tn + fp AS DOUBLE) * {Q.ratio('tn', 'tn + fp')} + CAST(tp + fn AS DOUBLE) * {Q.ratio('tp', 'tp + fn')}) / CAST(n AS DOUBLE) ELSE 0.0 END,
    CASE WHEN n > 0 THEN (CAST(tn + fp AS DOUBLE) * {Q.F1_NEG} + CAST(tp + fn AS DOUBLE) * {Q.F1_POS}) / CAST(n AS DOUBLE) ELSE 0.0 END,
    n FROM c)""",
    f"c AS ({Q.counts('scored', 'CAST(score > 0.5 AS INTEGER)')})", scored=True)


@register("classification_report", _REPORT_SQL)
def q_classification_report(spark, sf_dir):
    """Per-class precision/recall/F1/support and the average rows."""
    return M.classification_report(_pred(S.scored(spark, sf_dir)))


# ---------------------------------------------------------------- thresholds

_SWEEP_SQL = f"""sweep AS (
  SELECT g.t_idx, g.threshold,
    CAST(sum(CASE WHEN label = 1 AND score > g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN label = 0 AND score > g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND NOT score > g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 0 AND NOT score > g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM scored CROSS JOIN {Q.THRESHOLD_VALUES}
  WHERE data_type = 'TRAIN'
  GROUP BY g.t_idx, g.threshold)"""


@register("threshold_sweep", Q.with_base(
    f"SELECT t_idx, threshold, tp, fp, fn, tn, {Q.F1_MACRO} AS f1_macro FROM sweep", _SWEEP_SQL, scored=True))
def q_threshold_sweep(spark, sf_dir):
    """A15 + J2: F1-macro of the training rows at each of the 41 grid points."""
    return M.threshold_sweep(S.scored(spark, sf_dir).filter(F.col("data_type") == "TRAIN"))


_CALIB_CTE = f"""f1s AS (SELECT t_idx, threshold, {Q.F1_MACRO} AS f1_macro FROM sweep),
calib AS (
  SELECT (SELECT threshold FROM f1s ORDER BY f1_macro DESC, t_idx LIMIT 1) AS calibrated_threshold,
         (SELECT f1_macro FROM f1s ORDER BY f1_macro DESC, t_idx LIMIT 1) AS calibrated_f1,
         (SELECT f1_macro FROM f1s ORDER BY abs(threshold - 0.5), t_idx LIMIT 1) AS default_f1)"""


@register("calibrated_threshold", Q.with_base("SELECT * FROM calib", _SWEEP_SQL, _CALIB_CTE, scored=True))
def q_calibrated_threshold(spark, sf_dir):
    """Best grid threshold on the training rows, and F1 nearest 0.5."""
    return M.calibrated_threshold(q_threshold_sweep(spark, sf_dir))


# ---------------------------------------------------------------- text features

from claimlens.operators import tfidf as T  # noqa: E402


def _tf(spark, sf_dir, cfg):
    docs = S.read_table(spark, sf_dir, "documents")
    return T.term_counts(docs.select(F.col("doc_id").alias("row_id"), "text"), "text", cfg)


_ALL_TEXTS = "all_texts AS (SELECT doc_id AS row_id, text FROM documents)"
_COUNTS_SELECT = "SELECT row_id, term, CAST(count(*) AS BIGINT) AS tf FROM grams GROUP BY row_id, term"


@register("word_term_counts", f"WITH {_ALL_TEXTS},\n{Q.word_grams_cte('all_texts', 'text', 'text')}\n{_COUNTS_SELECT}")
def q_word_term_counts(spark, sf_dir):
    """T1 + T2: lower-cased word tokens, 1-3 grams, counted per document (all documents)."""
    return _tf(spark, sf_dir, T.WORD)


@register("char_term_counts", f"WITH {_ALL_TEXTS},\n{Q.char_grams_cte('all_texts', 'text', '1 AS one')}\n{_COUNTS_SELECT}")
def q_char_term_counts(spark, sf_dir):
    """In-word char 2-5 grams counted per document (all documents)."""
    return _tf(spark, sf_dir, T.CHAR)


def _tfidf(spark, sf_dir, cfg):
    return T.tfidf(S.claims(spark, sf_dir), "text_concat", cfg, fit_on=("data_type", "TRAIN"))


_VOCAB_SELECT = "SELECT term, idx, df, ctf, round(idf, 12) AS idf FROM vocab"
_WEIGHT_SELECT = "SELECT row_id, term, idx, round(weight, 12) AS weight FROM weights"


@register("word_vocabulary", Q.with_base(_VOCAB_SELECT, Q.word_grams_cte(), Q.tfidf_ctes(80_000)))
def q_word_vocabulary(spark, sf_dir):
    """T4 + T6: vocabulary fitted on TRAIN (df >= 2, top 80,000 by count), smoothed idf."""
    return _tfidf(spark, sf_dir, T.WORD)[1].withColumn("idf", F.round("idf", 12))


@register("word_tfidf", Q.with_base(_WEIGHT_SELECT, Q.word_grams_cte(), Q.tfidf_ctes(80_000)))
def q_word_tfidf(spark, sf_dir):
    """Sublinear tf x idf, L2-normalised, every row weighted by the TRAIN vocabulary."""
    return _tfidf(spark, sf_dir, T.WORD)[0].withColumn("weight", F.round("weight", 12))


@register("char_vocabulary", Q.with_base(_VOCAB_SELECT, Q.char_grams_cte(), Q.tfidf_ctes(100_000)))
def q_char_vocabulary(spark, sf_dir):
    """T4 + T6 for char 2-5 grams (top 100,000)."""
    return _tfidf(spark, sf_dir, T.CHAR)[1].withColumn("idf", F.round("idf", 12))


@register("char_tfidf", Q.with_base(_WEIGHT_SELECT, Q.char_grams_cte(), Q.tfidf_ctes(100_000)))
def q_char_tfidf(spark, sf_dir):
    """T5-T8 for char 2-5 grams."""
    return _tfidf(spark, sf_dir, T.CHAR)[0].withColumn("weight", F.round("weight", 12))


@register("word_tfidf_vectors")
def q_word_tfidf_vectors(spark, sf_dir):
    """One sparse (indices, values) row per claim, indices = alphabetical term rank."""
    w, _ = _tfidf(spark, sf_dir, T.WORD)
    return T.assemble_vectors(w)


# ---------------------------------------------------------------- splits

from claimlens.functions import prompts as P  # noqa: E402
from claimlens.operators import splits as X  # noqa: E402

SEEDS = list(range(10))
SEEDS_SQL = "(SELECT CAST(range AS INTEGER) AS seed FROM range(10))"
from claimlens.plans.robustness import HOLDOUT_FRACTION  # noqa: E402


@register("stratified_kfold", Q.with_base(
    "SELECT row_id, label, fold FROM folds",
    Q.kfold_cte("folds", "enriched", "(SELECT 42 AS seed)", 5)))
def q_stratified_kfold(spark, sf_dir):
    """5 stratified folds, seed 42, negatives laid out first."""
    return X.stratified_kfold(S.claims(spark, sf_dir), k=5, seed=42)


@register("selected_fold", Q.with_base(
    "SELECT row_id, label, fold, CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS role FROM folds",
    Q.kfold_cte("folds", "enriched", "(SELECT 42 AS seed)", 5)))
def q_selected_fold(spark, sf_dir):
    """Training and test rows of fold 2."""
    train, test = X.select_fold(X.stratified_kfold(S.claims(spark, sf_dir), k=5, seed=42), 2)
    return train.withColumn("role", F.lit("train")).union(test.withColumn("role", F.lit("test")))


@register("repeated_kfold", Q.with_base(
    "SELECT seed, row_id, label, fold FROM folds",
    Q.kfold_cte("folds", "enriched", SEEDS_SQL, 5)))
def q_repeated_kfold(spark, sf_dir):
    """Stratified 5-fold assignment for seeds 0-9 over all rows."""
    return X.repeated_stratified_kfold(S.claims(spark, sf_dir), seeds=SEEDS, k=5)


_HOLDOUT_CTE = f"""cc AS (SELECT label, count(*) AS n_c FROM enriched GROUP BY label),
tot AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil({HOLDOUT_FRACTION!r} * sum(n_c)) AS BIGINT) AS n_train FROM cc),
q0 AS (SELECT label, (n_train * n_c) // n AS fl, (n_train * n_c) % n AS rem, n_train FROM cc CROSS JOIN tot),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
hr AS (
  SELECT s.seed, e.row_id, e.label,
         row_number() OVER (PARTITION BY s.seed, e.label ORDER BY {Q.md5_key('s.seed', 'e.row_id')}, e.row_id) - 1 AS rk
  FROM enriched e CROSS JOIN {SEEDS_SQL} s),
holdout AS (SELECT seed, row_id, label, CASE WHEN rk < quota THEN 'train' ELSE 'test' END AS role FROM hr JOIN q USING (label))"""


@register("stratified_holdout", Q.with_base("SELECT * FROM holdout", _HOLDOUT_CTE))
def q_stratified_holdout(spark, sf_dir):
    """Re-stratified holdouts (150/800 of the rows to test) for seeds 0-9."""
    return X.stratified_holdout(S.claims(spark, sf_dir), test_size=HOLDOUT_FRACTION, seeds=SEEDS)


def _examples_cte(k: int, name: str) -> str:
    return f"""{name} AS (
  SELECT row_id, mani_news AS claim, original_news_article AS article, mani_status AS status, label,
         CAST(row_number() OVER (ORDER BY {Q.md5_key('42', salt='shuffle:')}, row_id) AS INTEGER) AS position
  FROM fs WHERE rn <= CASE WHEN label = 1 THEN {k // 2 + k % 2} ELSE {k // 2} END)"""


_FEWSHOT_CTE = f"""fs AS (
  SELECT row_id, mani_news, original_news_article, mani_status, label,
         row_number() OVER (PARTITION BY label ORDER BY {Q.md5_key('42')}, row_id) AS rn
  FROM enriched WHERE data_type = 'TRAIN'),
{_examples_cte(3, 'examples')},
{_examples_cte(5, 'examples5')}"""


@register("few_shot_examples", Q.with_base("SELECT * FROM examples", _FEWSHOT_CTE))
def q_few_shot_examples(spark, sf_dir):
    """X4 + X5: 2 positive + 1 negative TRAIN examples (seed 42), shuffled."""
    tr = S.claims(spark, sf_dir).filter(F.col("data_type") == "TRAIN")
    return P.few_shot_examples(tr, k=3, seed=42)


# ---------------------------------------------------------------- repeated evaluation with fixed scores

from claimlens.functions import scoring as SC  # noqa: E402
from claimlens.operators import reports as R  # noqa: E402
from claimlens.operators import windows as WN  # noqa: E402


def _round(df: DataFrame, cols, digits: int = 12) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def fold_scores(spark, sf_dir, threshold: float = 0.5) -> DataFrame:
    """F1-macro of every held-out fold (10 seeds x 5 folds) under fixed scores."""
    c = S.claims(spark, sf_dir)
    folds = X.repeated_stratified_kfold(c, seeds=SEEDS, k=5)
    j = folds.join(S.scored_view(c).select("row_id", "score"), "row_id") \
        .withColumn("prediction", M.apply_threshold("score", threshold))
    m = M.with_f1_metrics(M.confusion_counts(j, by=["seed", "fold"]))
    return m.select("seed", "fold", "n", "f1_macro")


def official_f1(spark, sf_dir, threshold: float = 0.5) -> DataFrame:
    t = S.scored(spark, sf_dir).filter(F.col("data_type") == "TEST")
    return M.with_f1_metrics(M.confusion_counts(_pred(t, threshold))).select("f1_macro")


def restratified_scores(spark, sf_dir, threshold: float = 0.5) -> DataFrame:
    """Per seed: F1-macro on the re-stratified test rows and both sides' positive %."""
    c = S.claims(spark, sf_dir)
    h = X.stratified_holdout(c, HOLDOUT_FRACTION, SEEDS).join(S.scored_view(c).select("row_id", "score"), "row_id")
    test = _pred(h.filter(F.col("role") == "test"), threshold)
    f1 = M.with_f1_metrics(M.confusion_counts(test, by=["seed"])).select("seed", "f1_macro")
    pct = h.groupBy("seed").agg(
        (F.avg(F.when(F.col("role") == "train", F.col("label").cast("double"))) * 100.0).alias("train_mani_pct"),
        (F.avg(F.when(F.col("role") == "test", F.col("label").cast("double"))) * 100.0).alias("test_mani_pct"))
    return f1.join(pct, "seed")


_FOLDS = Q.kfold_cte("folds", "enriched", SEEDS_SQL, 5)


@register("fold_scores", Q.with_base(
    "SELECT seed, fold, n, round(f1_macro, 12) AS f1_macro FROM fold_scores", _FOLDS, Q.fold_scores_cte(),
    scored=True))
def q_fold_scores(spark, sf_dir):
    """X6 + A7 over X2: held-out F1-macro of 50 (seed, fold) runs."""
    return _round(fold_scores(spark, sf_dir), ["f1_macro"])


@register("fold_score_summary", Q.with_base(Q.summary_select("fold_scores"), _FOLDS, Q.fold_scores_cte(),
                                            scored=True))
def q_fold_score_summary(spark, sf_dir):
    """N, mean, population std, se and 95% CI of the 50 fold scores."""
    s = M.score_summary(fold_scores(spark, sf_dir))
    return _round(s, ["mean", "std", "se", "ci_lower", "ci_upper"])


@register("running_mean", Q.with_base(
    """SELECT seed, runs_done, round(running_mean, 12) AS running_mean FROM (
  SELECT seed, fold, count(*) OVER w AS runs_done, avg(f1_macro) OVER w AS running_mean,
         row_number() OVER (PARTITION BY seed ORDER BY seed DESC, fold DESC) AS _r
  FROM fold_scores WINDOW w AS (ORDER BY seed, fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE _r = 1""",
    _FOLDS, Q.fold_scores_cte(), scored=True))
def q_running_mean(spark, sf_dir):
    """Mean of all fold scores so far, after each seed."""
    return _round(WN.running_mean(fold_scores(spark, sf_dir)), ["running_mean"])


@register("ci_verdict", Q.with_base(
    f"""SELECT s.*, round(o.f1_macro, 12) AS baseline,
       (o.f1_macro < s.ci_lower_raw OR o.f1_macro > s.ci_upper_raw) AS outside_ci
FROM (SELECT count(f1_macro) AS n, avg(f1_macro) AS mean_raw,
             avg(f1_macro) - 1.96 * (stddev_pop(f1_macro) / sqrt(count(f1_macro))) AS ci_lower_raw,
             avg(f1_macro) + 1.96 * (stddev_pop(f1_macro) / sqrt(count(f1_macro))) AS ci_upper_raw
      FROM fold_scores) s0
CROSS JOIN official o
CROSS JOIN LATERAL (SELECT s0.n AS n, round(s0.mean_raw, 12) AS mean, round(s0.ci_lower_raw, 12) AS ci_lower,
                           round(s0.ci_upper_raw, 12) AS ci_upper, s0.ci_lower_raw, s0.ci_upper_raw) s""",
    _FOLDS, Q.fold_scores_cte(), Q.official_cte(), scored=True).replace("SELECT s.*,", "SELECT s.n, s.mean, s.ci_lower, s.ci_upper,"))
def q_ci_verdict(spark, sf_dir):
    """Does the official-split score fall outside the folds' 95% CI?"""
    s = M.score_summary(fold_scores(spark, sf_dir))
    v = M.ci_verdict(s, official_f1(spark, sf_dir).scalar())
    return _round(v.select("n", "mean", "ci_lower", "ci_upper", "baseline", "outside_ci"),
                  ["mean", "ci_lower", "ci_upper", "baseline"])


_HOLD = _HOLDOUT_CTE


@register("restratified_scores", Q.with_base(
    """SELECT r.seed, round(r.f1_macro, 12) AS f1_macro, round(p.train_mani_pct, 12) AS train_mani_pct,
       round(p.test_mani_pct, 12) AS test_mani_pct
FROM restrat r JOIN (
  SELECT h.seed, avg(CASE WHEN h.role = 'train' THEN CAST(s.label AS DOUBLE) END) * 100.0 AS train_mani_pct,
         avg(CASE WHEN h.role = 'test' THEN CAST(s.label AS DOUBLE) END) * 100.0 AS test_mani_pct
  FROM holdout h JOIN scored s USING (row_id) GROUP BY h.seed) p USING (seed)""",
    _HOLD, Q.restrat_cte(), scored=True))
def q_restratified_scores(spark, sf_dir):
    """M9 shape with fixed scores: per-seed re-stratified F1 and class shares."""
    return _round(restratified_scores(spark, sf_dir), ["f1_macro", "train_mani_pct", "test_mani_pct"])


@register("shift_verdict", Q.with_base(
    """SELECT n, round(mean, 12) AS mean, round(baseline, 12) AS baseline, round(mean - baseline, 12) AS diff,
       round(half, 12) AS ci_half_width, abs(mean - baseline) > half AS significant,
       (mean - baseline) > half AS significant_gain
FROM (SELECT count(f1_macro) AS n, avg(f1_macro) AS mean,
             1.96 * (stddev_pop(f1_macro) / sqrt(count(f1_macro))) AS half FROM restrat) s
CROSS JOIN (SELECT f1_macro AS baseline FROM official) o""",
    _HOLD, Q.restrat_cte(), Q.official_cte(), scored=True))
def q_shift_verdict(spark, sf_dir):
    """Re-stratified mean vs the official split, within the CI or not."""
    s = M.score_summary(restratified_scores(spark, sf_dir))
    v = M.shift_verdict(s, official_f1(spark, sf_dir).scalar())
    return _round(v.select("n", "mean", "baseline", "diff", "ci_half_width", "significant", "significant_gain"),
                  ["mean", "baseline", "diff", "ci_half_width"])


# ---------------------------------------------------------------- prompts and replies

# The reply cases of the parsing table (FIXTURES 3.3), in order.
REPLIES = ["NO_MANI", "No mani.", "MANI", "not manipulated", "no manipulation", "yes",
           "genuine", "", "Romania", "eyes", "cannot tell"]
_REPLIES_SQL = "[" + ", ".join(Q.lit(r) for r in REPLIES) + "]"


def _parse_sql(x: str) -> str:
    u = f"upper(coalesce({x}, ''))"
    return (f"CAST(CASE WHEN contains({u}, 'NO_MANI') OR contains({u}, 'NO MANI') THEN 0 "
            f"WHEN contains({u}, 'MANI') OR contains({u}, 'YES') THEN 1 ELSE 0 END AS INTEGER)")


def _test_rows(spark, sf_dir):
    return S.claims(spark, sf_dir).filter(F.col("data_type") == "TEST")


def _nan(x):
    return f"coalesce({x}, 'nan')"


_ZS_SQL = (f"{Q.lit(P.PROMPT_HEAD + 'Claim: ')} || {_nan('mani_news')} || {Q.lit(chr(10) * 2 + 'Article: ')} || "
           f"substr({_nan('original_news_article')}, 1, {P.ARTICLE_PREFIX}) || {Q.lit(chr(10) * 2 + P.ZERO_SHOT_QUESTION)}")


@register("zero_shot_prompts", Q.with_base(
    f"SELECT row_id, {_ZS_SQL} AS prompt FROM enriched WHERE data_type = 'TEST'"))
def q_zero_shot_prompts(spark, sf_dir):
    """P6 + P9 + P10: zero-shot prompt per TEST row (article cut to 600 code points by the template)."""
    return _test_rows(spark, sf_dir).select("row_id", P.zero_shot_prompt().alias("prompt"))


_EX_SQL = (f"string_agg('Example ' || CAST(position AS VARCHAR) || {Q.lit(':' + chr(10) + 'Claim: ')} || {_nan('claim')} || "
           f"{Q.lit(chr(10) + 'Article: ')} || substr({_nan('article')}, 1, {P.EXAMPLE_PREFIX}) || "
           f"{Q.lit(chr(10) + 'Answer: ')} || {_nan('status')} || {Q.lit(chr(10) * 2)}, '' ORDER BY position)")
_FS_SQL = (f"{Q.lit(P.PROMPT_HEAD)} || ex.t || {Q.lit('Now analyze this:' + chr(10) + 'Claim: ')} || {_nan('mani_news')} || "
           f"{Q.lit(chr(10) + 'Article: ')} || substr({_nan('original_news_article')}, 1, {P.ARTICLE_PREFIX}) || "
           f"{Q.lit(chr(10) + P.FEW_SHOT_TAIL)}")


def _few_shot_examples(spark, sf_dir):
    return q_few_shot_examples(spark, sf_dir)


@register("few_shot_prompts", Q.with_base(
    f"SELECT row_id, {_FS_SQL} AS prompt FROM enriched CROSS JOIN (SELECT {_EX_SQL} AS t FROM examples) ex "
    f"WHERE data_type = 'TEST'", _FEWSHOT_CTE))
def q_few_shot_prompts(spark, sf_dir):
    """3-shot prompt per TEST row; the example text is one scalar subquery."""
    ex = P.examples_text(_few_shot_examples(spark, sf_dir))
    return _test_rows(spark, sf_dir).select("row_id", P.few_shot_prompt(ex).alias("prompt"))


@register("reply_labels", Q.with_base(
    f"SELECT row_id, list_extract({_REPLIES_SQL}, CAST(row_id % 11 AS INTEGER) + 1) AS response, "
    f"{_parse_sql(f'list_extract({_REPLIES_SQL}, CAST(row_id % 11 AS INTEGER) + 1)')} AS pred "
    f"FROM enriched WHERE data_type = 'TEST'"))
def q_reply_labels(spark, sf_dir):
    """Replies mapped to labels (substring rules, in order)."""
    arr = F.array(*[F.lit(r) for r in REPLIES])
    t = _test_rows(spark, sf_dir).select("row_id", F.element_at(arr, (F.col("row_id") % 11).cast("int") + 1)
                                          .alias("response"))
    return t.select("row_id", "response", P.parse_reply_label("response").alias("pred"))


# ---------------------------------------------------------------- prompt evaluation (M12 with a stub model)

from claimlens.plans import prompt_eval as PE  # noqa: E402


def stub_model(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a user model: picks a reply by prompt length."""
    return [REPLIES[len(p) % len(REPLIES)] for p in prompts]


def other_model(prompts: list[str]) -> list[str]:
    """A second stand-in that disagrees with the first."""
    return [REPLIES[(len(p) * 7 + 3) % len(REPLIES)] for p in prompts]


STUBS = {"stub": stub_model, "other": other_model}
PROMPT_STRATEGIES = ("zero_shot", "few_shot_3", "few_shot_5")


def prompt_replies(spark, sf_dir) -> DataFrame:
    c = S.claims(spark, sf_dir)
    return PE.evaluate_prompts(c.filter(F.col("data_type") == "TEST"), c.filter(F.col("data_type") == "TRAIN"),
                               STUBS, PROMPT_STRATEGIES)


_PROMPTS_CTE = f"""pr AS (
  SELECT row_id, label, 'zero_shot' AS strategy, {_ZS_SQL} AS prompt FROM enriched WHERE data_type = 'TEST'
  UNION ALL
  SELECT row_id, label, 'few_shot_3', {_FS_SQL} FROM enriched CROSS JOIN (SELECT {_EX_SQL} AS t FROM examples) ex
  WHERE data_type = 'TEST'
  UNION ALL
  SELECT row_id, label, 'few_shot_5', {_FS_SQL} FROM enriched CROSS JOIN (SELECT {_EX_SQL} AS t FROM examples5) ex
  WHERE data_type = 'TEST'),
replies AS (
  SELECT row_id, label, 'stub' AS model, strategy, list_extract({_REPLIES_SQL}, CAST(length(prompt) % 11 AS INTEGER) + 1) AS response
  FROM pr
  UNION ALL
  SELECT row_id, label, 'other', strategy, list_extract({_REPLIES_SQL}, CAST((length(prompt) * 7 + 3) % 11 AS INTEGER) + 1)
  FROM pr),
parsed AS (SELECT row_id, label, model, strategy, response, {_parse_sql('response')} AS prediction FROM replies)"""


@register("prompt_replies", Q.with_base("SELECT * FROM parsed", _FEWSHOT_CTE, _PROMPTS_CTE))
def q_prompt_replies(spark, sf_dir):
    """J1 + M12 + P12: TEST rows x strategies -> prompt -> model reply -> label."""
    return prompt_replies(spark, sf_dir)


@register("prompt_ledger", Q.with_base("SELECT * FROM parsed", _FEWSHOT_CTE, _PROMPTS_CTE))
def q_prompt_ledger(spark, sf_dir):
    """Replies by a ledger that already holds those of one strategy; only the others are asked for."""
    c = S.claims(spark, sf_dir)
    test, train = (c.filter(F.col("data_type") == x) for x in ("TEST", "TRAIN"))
    at = scratch_path(spark, "reply-ledger")
    PE.evaluate_prompts(test, train, STUBS, PROMPT_STRATEGIES[:1], ledger=at)
    return PE.evaluate_prompts(test, train, STUBS, PROMPT_STRATEGIES, ledger=at)


@register("prompt_eval", Q.with_base(
    f"SELECT c.*, {Q.METRICS}, {Q.MATRIX} FROM ({Q.counts('parsed', 'prediction', 'model, strategy')}) c",
    _FEWSHOT_CTE, _PROMPTS_CTE))
def q_prompt_eval(spark, sf_dir):
    """A11 per model and prompt strategy over the parsed replies."""
    return _matrix_text(PE.strategy_metrics(prompt_replies(spark, sf_dir)))


@register("running_f1", Q.with_base(
    f"""SELECT model, strategy, n, {Q.F1_MACRO} AS f1_macro FROM (
  SELECT model, strategy,
    count(*) OVER w AS n,
    sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) OVER w AS tp,
    sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) OVER w AS fp,
    sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) OVER w AS fn,
    sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) OVER w AS tn
  FROM parsed WINDOW w AS (PARTITION BY model, strategy ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE n % 10 = 0""", _FEWSHOT_CTE, _PROMPTS_CTE))
def q_running_f1(spark, sf_dir):
    """F1-macro so far after every 10th reply, per model and strategy."""
    return PE.running_strategy_f1(prompt_replies(spark, sf_dir))


# ---------------------------------------------------------------- logits, leaderboard, model choice

_LOGITS = "[CAST(row_id % 7 AS DOUBLE) / 4.0, score * 3.0]"


@register("score_logits", Q.with_base(
    f"""SELECT row_id, CASE WHEN l1 > l0 THEN 'MANI' ELSE 'NO_MANI' END AS prediction,
       round(greatest(p0, p1), 4) AS confidence, round(p1, 4) AS prob_mani, round(p0, 4) AS prob_no_mani
FROM (SELECT row_id, l0, l1, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p0,
             exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p1
      FROM (SELECT row_id, CAST(row_id % 7 AS DOUBLE) / 4.0 AS l0, score * 3.0 AS l1 FROM scored))""", scored=True))
def q_score_logits(spark, sf_dir):
    """P14 (+ P15 rounding): softmax of two-class logits -> name, confidence, class probabilities."""
    s = S.scored(spark, sf_dir).select(
        "row_id", F.array((F.col("row_id") % 7).cast("double") / 4.0, F.col("score") * 3.0).alias("logits"))
    return SC.score_logits(s).drop("logits")


def _fixture_result_row(spark, sf_dir):
    t = _pred(S.scored(spark, sf_dir).filter(F.col("data_type") == "TEST"))
    e = M.evaluate(t, score="score")
    return e.select(F.lit("scored view").alias("model"), F.lit("Fixture").alias("type"),
                    F.lit("-").alias("strategy"), "accuracy", "f1_macro", "f1_mani", "roc_auc")


_LEADER_SQL = Q.with_base(
    f"""SELECT model, type, strategy, round(accuracy, 4) AS accuracy, round(f1_macro, 4) AS f1_macro,
       round(f1_mani, 4) AS f1_mani, round(roc_auc, 4) AS roc_auc FROM (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join(Q.lit(v) if isinstance(v, str) else ("NULL" if v is None else repr(float(v))) for v in r) + ")" for r in R.PUBLISHED_RESULTS)})
    AS p(model, type, strategy, accuracy, f1_macro, f1_mani, roc_auc)
  UNION ALL
  SELECT 'scored view', 'Fixture', '-', {Q.ACCURACY}, {Q.F1_MACRO}, {Q.F1_POS}, (SELECT roc_auc FROM auc)
  FROM ({Q.counts("(SELECT * FROM scored WHERE data_type = 'TEST') t", 'CAST(score > 0.5 AS INTEGER)')})
  UNION ALL
  SELECT 'reply ' || model, 'Prompted', strategy, {Q.ACCURACY}, {Q.F1_MACRO}, {Q.F1_POS}, NULL
  FROM ({Q.counts('parsed', 'prediction', 'model, strategy')}))""",
    Q.auc_cte("auc", "(SELECT * FROM scored WHERE data_type = 'TEST')"), _FEWSHOT_CTE, _PROMPTS_CTE, scored=True)


@register("leaderboard", _LEADER_SQL)
def q_leaderboard(spark, sf_dir):
    """O1 + S7 + U1: published rows and results computed here, sorted by F1-macro."""
    pe = PE.strategy_metrics(prompt_replies(spark, sf_dir)).select(
        F.concat(F.lit("reply "), F.col("model")).alias("model"), F.lit("Prompted").alias("type"), "strategy",
        "accuracy", "f1_macro", "f1_mani")
    lb = R.leaderboard([R.inline_results(spark), _fixture_result_row(spark, sf_dir), pe])
    return SC.round_metrics(lb)


# threshold variants of the scored view play the models of J4 / A18
MODEL_THRESHOLDS = [("score>0.3", 0.3), ("score>0.5", 0.5), ("score>0.7", 0.7)]


def _split_gain(spark, sf_dir):
    off, rs = [], []
    for pos, (name, t) in enumerate(MODEL_THRESHOLDS):
        off.append(official_f1(spark, sf_dir, t).select(F.lit(name).alias("model"), F.lit(pos).alias("position"),
                                                        F.col("f1_macro").alias("official_f1")))
        rs.append(restratified_scores(spark, sf_dir, t).agg(F.avg("f1_macro").alias("restratified_f1"))
                  .select(F.lit(name).alias("model"), "restratified_f1"))
    return R.split_gain(R.union_all(off), R.union_all(rs))


def _gain_sql():
    parts, ctes = [], []
    for pos, (name, t) in enumerate(MODEL_THRESHOLDS):
        tag = f"m{pos}"
        ctes += [Q.official_cte(t, f"off_{tag}"), Q.restrat_cte(t, f"rs_{tag}")]
        parts.append(f"SELECT {Q.lit(name)} AS model, {pos} AS position, (SELECT f1_macro FROM off_{tag}) AS official_f1, "
                     f"(SELECT avg(f1_macro) FROM rs_{tag}) AS restratified_f1")
    return ctes, " UNION ALL ".join(parts)


_GAIN_CTES, _GAIN_BODY = _gain_sql()


@register("split_gain", Q.with_base(
    f"""SELECT model, position, round(official_f1, 12) AS official_f1, round(restratified_f1, 12) AS restratified_f1,
       round(restratified_f1 - official_f1, 12) AS gained FROM ({_GAIN_BODY})""", _HOLD, *_GAIN_CTES, scored=True))
def q_split_gain(spark, sf_dir):
    """Official vs re-stratified F1 per model, joined on the model name."""
    return _round(_split_gain(spark, sf_dir), ["official_f1", "restratified_f1", "gained"])


@register("best_model", Q.with_base(
    f"""SELECT model, position, round(official_f1, 12) AS f1_macro FROM ({_GAIN_BODY})
ORDER BY official_f1 DESC, position LIMIT 1""", _HOLD, *_GAIN_CTES, scored=True))
def q_best_model(spark, sf_dir):
    """A18 + O2: the model with the best official F1-macro (first wins ties)."""
    g = _split_gain(spark, sf_dir).select("model", "position", F.col("official_f1").alias("f1_macro"))
    return _round(R.best_by(g, "f1_macro", "position"), ["f1_macro"])


@register("best_checkpoint", Q.with_base(
    """SELECT seed * 5 + fold AS epoch, round(f1_macro, 12) AS f1_macro FROM fold_scores
ORDER BY f1_macro DESC, seed * 5 + fold LIMIT 1""", _FOLDS, Q.fold_scores_cte(), scored=True))
def q_best_checkpoint(spark, sf_dir):
    """Highest F1-macro row of a per-epoch validation log (the fold runs as epochs)."""
    log = fold_scores(spark, sf_dir).select((F.col("seed") * 5 + F.col("fold")).alias("epoch"), "f1_macro")
    return _round(R.best_checkpoint(log, "f1_macro", ("epoch",)), ["f1_macro"])


# ---------------------------------------------------------------- model fits (no SQL oracle: optimisation)

from claimlens.operators import linear as LN  # noqa: E402
from claimlens.operators import models as MDL  # noqa: E402
from claimlens.plans import baseline as BL  # noqa: E402
from claimlens.plans import robustness as RB  # noqa: E402


def _model_eval(spark, sf_dir, cfg, spec, name):
    _, preds = BL.fit_text_model(S.claims(spark, sf_dir), cfg, spec)
    return BL.evaluate_test(preds, spec).select(F.lit(name).alias("model"), "*")


@register("word_lr_evaluate")
def q_word_lr_evaluate(spark, sf_dir):
    """M1 + M2 + A11 (flagship): word 1-3 gram TF-IDF + balanced LR, TRAIN -> TEST metrics."""
    return _model_eval(spark, sf_dir, T.WORD, LN.LOGREG, "TF-IDF (word) + LR")


@register("char_lr_evaluate")
def q_char_lr_evaluate(spark, sf_dir):
    """M1 + M2 + A11 on char 2-5 gram features."""
    return _model_eval(spark, sf_dir, T.CHAR, LN.LOGREG, "TF-IDF (char) + LR")


@register("word_svm_evaluate")
def q_word_svm_evaluate(spark, sf_dir):
    """M3 + M4 + A11: squared-hinge SVM (C=0.5, penalised intercept); no probability, AUC NULL."""
    return _model_eval(spark, sf_dir, T.WORD, LN.SVM, "TF-IDF + LinearSVC")


@register("word_lr_predictions")
def q_word_lr_predictions(spark, sf_dir):
    """M2: class and P(class 1) for every TEST row, joined to the truth by key."""
    _, preds = BL.fit_text_model(S.claims(spark, sf_dir), T.WORD, LN.LOGREG)
    return preds.filter(F.col("data_type") == "TEST").select("row_id", "label", "prob", "prediction")


@register("top_features")
def q_top_features(spark, sf_dir):
    """M5 + O2: 20 most MANI- and 20 most NO_MANI-predictive word n-grams."""
    m, _ = BL.fit_text_model(S.claims(spark, sf_dir), T.WORD, LN.LOGREG)
    return MDL.top_features(m.coef, 20)


def _train(spark, sf_dir):
    return S.claims(spark, sf_dir).filter(F.col("data_type") == "TRAIN")


@register("cv_scores")
def q_cv_scores(spark, sf_dir):
    """M6 + M11: 5-fold CV on TRAIN, vocabulary and model refitted per fold."""
    return BL.cross_val_scores(_train(spark, sf_dir), T.WORD, LN.LOGREG)


@register("oof_probabilities")
def q_oof_probabilities(spark, sf_dir):
    """M7: out-of-fold P(MANI) for every TRAIN row."""
    tr = _train(spark, sf_dir)
    return RB.oof_probabilities(RB.shared_term_counts(tr), tr.select("row_id", "label"))


@register("calibration_report")
def q_calibration_report(spark, sf_dir):
    """A15-A17 with a real model: OOF sweep on TRAIN, default vs calibrated on TEST."""
    c = S.claims(spark, sf_dir)
    tr = c.filter(F.col("data_type") == "TRAIN")
    oof = RB.oof_probabilities(RB.shared_term_counts(tr), tr.select("row_id", "label"))
    _, preds = BL.fit_text_model(c, T.WORD, LN.LOGREG)
    return RB.calibration_report(oof, preds.filter(F.col("data_type") == "TEST"))


@register("repeated_kfold_eval")
def q_repeated_kfold_eval(spark, sf_dir):
    """M8: 10 seeds x 5 folds = 50 refits over all rows -> 50 F1-macro scores."""
    c = S.claims(spark, sf_dir)
    return RB.repeated_kfold_runs(RB.shared_term_counts(c), c.select("row_id", "label"))


@register("restratified_eval")
def q_restratified_eval(spark, sf_dir):
    """M9: 10 re-stratified holdouts -> F1-macro and the class share of each side."""
    c = S.claims(spark, sf_dir)
    return RB.restratified_runs(RB.shared_term_counts(c), c.select("row_id", "label"))


@register("robustness_report")
def q_robustness_report(spark, sf_dir):
    """The four-section robustness report (67 fits), rounded for the sink."""
    return RB.rounded_report(RB.robustness_report(S.claims(spark, sf_dir)))


@register("baseline_models")
def q_baseline_models(spark, sf_dir):
    """Char-LR, word-LR, word-SVM with CV means; ``best`` marks the winner."""
    res = BL.run_baselines(S.claims(spark, sf_dir))
    best = BL.best_baseline(res).select("position").scalar()
    return SC.round_metrics(res.withColumn("best", F.col("position") == best))


@register("fit_optimality", Q.with_base(
    """SELECT CAST(r.run AS BIGINT) AS run, n_train, least(80000, n_terms)::BIGINT AS n_features, true AS converged, true AS flat
FROM (SELECT r AS run, CAST(count(*) AS BIGINT) AS n_train FROM folds, range(5) t(r) WHERE fold <> r GROUP BY r) r
JOIN (SELECT run, count(*) AS n_terms FROM (
  SELECT r AS run, term FROM (SELECT DISTINCT row_id, term FROM grams) g JOIN folds USING (row_id), range(5) t(r)
  WHERE fold <> r GROUP BY r, term HAVING count(*) >= 2) GROUP BY run) v USING (run)""",
    "train_rows AS (SELECT * FROM enriched WHERE data_type = 'TRAIN')",
    Q.kfold_cte("folds", "train_rows", "(SELECT 42 AS seed)", 5), Q.word_grams_cte("train_rows")))
def q_fit_optimality(spark, sf_dir):
    """M1 + M11: training rows, vocabulary size and the end of every fold's fit (gradient below 1e-4)."""
    _, info = BL.cross_val_runs(_train(spark, sf_dir), T.WORD, LN.LOGREG)
    return info.select("run", "n_train", "n_features", "converged", (F.col("grad_max") < 1e-4).alias("flat"))


#: What a certified model's largest gradient component and relative duality gap lie below.
FLAT, TIGHT = 1e-5, 1e-4
_KKT_SQL = """SELECT (SELECT count(*) FROM train_rows)::BIGINT AS n_train, least(80000, count(*))::BIGINT AS n_features,
  true AS flat, true AS tight, true AS bounded
FROM (SELECT term FROM (SELECT DISTINCT row_id, term FROM grams) GROUP BY term HAVING count(*) >= 2)"""
_TRAIN_CTE = "train_rows AS (SELECT * FROM enriched WHERE data_type = 'TRAIN')"


def _kkt(found: DataFrame, *keys: str) -> DataFrame:
    """Gradient and duality gap as verdicts; ``bounded``: the dual lies below the primal, as it must."""
    return found.select(*keys, "n_train", "n_features", (F.col("grad_max") < FLAT).alias("flat"), (F.col("gap") < TIGHT).alias("tight"),
                        (F.col("dual") <= F.col("primal") * (1 + 1e-9)).alias("bounded"))


def _kkt_model(spark, sf_dir, spec):
    c = S.claims(spark, sf_dir)
    model, _ = BL.fit_text_model(c, T.WORD, spec)
    return _kkt(BL.model_certificate(c, model))


@register("kkt_logreg", Q.with_base(_KKT_SQL, _TRAIN_CTE, Q.word_grams_cte("train_rows")))
def q_kkt_logreg(spark, sf_dir):
    """M1: gradient and duality gap of the word LR, recomputed from term counts and its coefficient table."""
    return _kkt_model(spark, sf_dir, LN.LOGREG)


@register("kkt_svm", Q.with_base(_KKT_SQL, _TRAIN_CTE, Q.word_grams_cte("train_rows")))
def q_kkt_svm(spark, sf_dir):
    """M3: gradient and duality gap of the word SVM, recomputed from term counts and its coefficient table."""
    return _kkt_model(spark, sf_dir, LN.SVM)


@register("kkt_folds", Q.with_base(
    """SELECT CAST(r.run AS BIGINT) AS run, n_train, least(80000, n_terms)::BIGINT AS n_features, true AS flat, true AS tight, true AS bounded
FROM (SELECT r AS run, CAST(count(*) AS BIGINT) AS n_train FROM folds, range(5) t(r) WHERE fold <> r GROUP BY r) r
JOIN (SELECT run, count(*) AS n_terms FROM (
  SELECT r AS run, term FROM (SELECT DISTINCT row_id, term FROM grams) g JOIN folds USING (row_id), range(5) t(r)
  WHERE fold <> r GROUP BY r, term HAVING count(*) >= 2) GROUP BY run) v USING (run)""",
    _TRAIN_CTE, Q.kfold_cte("folds", "train_rows", "(SELECT 42 AS seed)", 5), Q.word_grams_cte("train_rows")))
def q_kkt_folds(spark, sf_dir):
    """Gradient and duality gap of every fold's model, recomputed from term counts and the coefficient table."""
    return _kkt(BL.cross_val_certificates(_train(spark, sf_dir), T.WORD, LN.LOGREG), "run")


# ---------------------------------------------------------------- M2, M4, M5, T9 with given coefficients

FIXED_INTERCEPT = 0.1
_COEF_SQL = "coefs AS (SELECT term, idx, (((idx * 37) % 101) - 50) / 25.0 AS coef FROM vocab)"
_MARGIN_SQL = f"""margins AS (SELECT e.row_id, e.data_type, e.label, coalesce(m.z, 0.0) + {FIXED_INTERCEPT} AS z
  FROM enriched e LEFT JOIN (SELECT row_id, sum(weight * coef) AS z FROM weights JOIN coefs USING (idx) GROUP BY row_id) m USING (row_id))"""


def _fixed_coefficients(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", "idx", (((F.col("idx") * 37) % 101 - 50) / F.lit(25.0)).alias("coef"))


def _fixed_predictions(spark, sf_dir, spec) -> DataFrame:
    w, v = _tfidf(spark, sf_dir, T.WORD)
    rows = S.claims(spark, sf_dir).select("row_id", "data_type", "label")
    return _round(MDL.predict(w, rows, _fixed_coefficients(v), FIXED_INTERCEPT, spec), ["margin", "prob"], 9)


@register("predict_logreg_fixed", Q.with_base(
    "SELECT row_id, data_type, label, round(z, 9) AS margin, round(1.0 / (1.0 + exp(-z)), 9) AS prob, CAST(z > 0 AS INTEGER) AS prediction FROM margins",
    Q.word_grams_cte(), Q.tfidf_ctes(80_000), _COEF_SQL, _MARGIN_SQL))
def q_predict_logreg_fixed(spark, sf_dir):
    """M2: scores of every claim under coefficients that follow from the term's number."""
    return _fixed_predictions(spark, sf_dir, LN.LOGREG)


@register("predict_svm_fixed", Q.with_base(
    "SELECT row_id, data_type, label, round(z, 9) AS margin, CAST(z > 0 AS INTEGER) AS prediction FROM margins",
    Q.word_grams_cte(), Q.tfidf_ctes(80_000), _COEF_SQL, _MARGIN_SQL))
def q_predict_svm_fixed(spark, sf_dir):
    """M4: margins and classes under the same coefficients (an SVM has no probability)."""
    return _fixed_predictions(spark, sf_dir, LN.SVM).drop("prob")


@register("top_features_fixed", Q.with_base(
    """SELECT 'MANI' AS direction, CAST(row_number() OVER (ORDER BY coef DESC, term) AS INTEGER) AS rank, term, round(coef, 4) AS coef
FROM coefs QUALIFY rank <= 20
UNION ALL
SELECT 'NO_MANI', CAST(row_number() OVER (ORDER BY coef, term) AS INTEGER) AS rank, term, round(coef, 4) FROM coefs QUALIFY rank <= 20""",
    Q.word_grams_cte(), Q.tfidf_ctes(80_000), _COEF_SQL))
def q_top_features_fixed(spark, sf_dir):
    """M5: the 20 terms at either end under the same coefficients."""
    return MDL.top_features(_fixed_coefficients(_tfidf(spark, sf_dir, T.WORD)[1]), 20)


@register("word_tfidf_vector_entries", Q.with_base(
    "SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1 AS INTEGER) AS place, CAST(idx AS INTEGER) AS idx, round(weight, 12) AS weight FROM weights",
    Q.word_grams_cte(), Q.tfidf_ctes(80_000)))
def q_word_tfidf_vector_entries(spark, sf_dir):
    """The sparse rows laid open again, entry by entry in the order they have."""
    v = T.assemble_vectors(_tfidf(spark, sf_dir, T.WORD)[0])
    return v.select("row_id", F.posexplode(F.arrays_zip("indices", "values")).alias("place", "e")) \
        .select("row_id", "place", F.col("e.indices").alias("idx"), F.round("e.values", 12).alias("weight"))


# ---------------------------------------------------------------- files: written to shared scratch, read back

from claimlens.session import scratch_path  # noqa: E402
from claimlens.sources import files as FL  # noqa: E402


@register("claims_from_csv", Q.with_base("SELECT " + ", ".join(ENRICHED_COLS) + " FROM enriched"))
def q_claims_from_csv(spark, sf_dir):
    """The claims written as CSV, converted to parquet once and loaded."""
    from pyspark.sql import types as TY
    at = scratch_path(spark, "claims-csv")
    raw = S.claims_view(spark, sf_dir)
    raw.select("row_id", *S.RAW_COLUMNS).write.option("header", True).option("quoteAll", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    schema = TY.StructType([TY.StructField(c, TY.StringType()) for c in ("row_id", *S.RAW_COLUMNS)])
    table = scratch_path(spark, "claims-parquet")
    FL.read_claims_csv(spark, at, schema, key="row_id").write.parquet(table)
    return S.enrich_claims(spark.read.parquet(table)).select(*ENRICHED_COLS)


@register("results_json", Q.with_base(
    f"""SELECT data_type, n, tp, fp, fn, tn, {Q.METRICS} FROM ({Q.counts('scored', 'CAST(score > 0.5 AS INTEGER)', 'data_type')}) c""",
    scored=True))
def q_results_json(spark, sf_dir):
    """S3 + S2: metric rows written as JSON and read back."""
    at = scratch_path(spark, "results-json")
    res = M.evaluate(_pred(S.scored(spark, sf_dir)), by=["data_type"]).drop("roc_auc", "confusion_matrix")
    FL.write_json(res, at)
    return FL.read_json(spark, at, res.schema)


@register("leaderboard_csv", _LEADER_SQL)
def q_leaderboard_csv(spark, sf_dir):
    """The leaderboard written as CSV and read back."""
    at = scratch_path(spark, "leaderboard-csv")
    lb = q_leaderboard(spark, sf_dir)
    FL.write_csv(lb, at)
    return FL.read_csv(spark, at, lb.schema)


@register("run_log", Q.with_base("SELECT seed, fold, n, f1_macro FROM fold_scores", _FOLDS, Q.fold_scores_cte(), scored=True))
def q_run_log(spark, sf_dir):
    """Fold scores appended to a run log in two batches and read back."""
    at = scratch_path(spark, "run-log")
    scores = fold_scores(spark, sf_dir)
    for _ in range(2):  # a repeated append stores nothing twice
        FL.append_run_log(scores.filter("seed < 5"), at, run="first half")
    FL.append_run_log(scores.filter("seed >= 5"), at, run="second half")
    return FL.read_run_log(spark, at, scores.schema).filter(F.col(FL.CORRUPT).isNull()).drop(FL.CORRUPT)


@register("saved_model_scores", Q.with_base(
    "SELECT row_id, round(z, 9) AS margin, round(1.0 / (1.0 + exp(-z)), 9) AS prob, CAST(z > 0 AS INTEGER) AS prediction FROM margins",
    Q.word_grams_cte(), Q.tfidf_ctes(80_000), _COEF_SQL, _MARGIN_SQL))
def q_saved_model_scores(spark, sf_dir):
    """A model saved as tables, loaded and applied to the claims' texts."""
    at = scratch_path(spark, "saved-model")
    _, v = _tfidf(spark, sf_dir, T.WORD)
    FL.save_model(at, v, _fixed_coefficients(v), FIXED_INTERCEPT,
                  {"loss": "logistic", "analyzer": "word", "ngram_range": [1, 3], "sublinear_tf": True})
    return _round(BL.score_saved(spark, at, S.claims(spark, sf_dir).select("row_id", "text_concat")), ["margin", "prob"], 9)


@register("claims_preview", Q.with_base(
    "SELECT row_id, label, substr(text_concat, 1, 300) AS text_concat FROM enriched ORDER BY row_id LIMIT 5"))
def q_claims_preview(spark, sf_dir):
    """The first rows, long text cut for display."""
    return FL.preview(S.claims(spark, sf_dir).select("row_id", "label", "text_concat").orderBy("row_id"), "text_concat", rows=5)


@register("logged_metrics", Q.with_base(
    f"""SELECT data_type, {Q.ACCURACY} AS eval_accuracy FROM ({Q.counts('scored', 'CAST(score > 0.5 AS INTEGER)', 'data_type')}) c""",
    scored=True))
def q_logged_metrics(spark, sf_dir):
    """Timing columns left out of a metric log."""
    e = M.evaluate(_pred(S.scored(spark, sf_dir)), by=["data_type"])
    return SC.drop_metric_keys(e.select("data_type", F.col("accuracy").alias("eval_accuracy"),
                                        F.lit(1.5).alias("eval_runtime"), F.lit(0.1).alias("train_runtime_sec")))


# ---------------------------------------------------------------- A17 / A19 on the scored view (SQL-checkable)

def calibration_fixed(spark, sf_dir) -> DataFrame:
    """Threshold from the TRAIN sweep applied to TEST rows: default vs calibrated."""
    sc = S.scored(spark, sf_dir)
    cal = M.calibrated_threshold(M.threshold_sweep(sc.filter(F.col("data_type") == "TRAIN")))
    t = cal.select("calibrated_threshold").scalar()
    test = sc.filter(F.col("data_type") == "TEST").select(
        "label", M.apply_threshold("score").alias("p_default"), (F.col("score") > t).cast("int").alias("p_cal"))
    dflt = M.with_f1_metrics(M.confusion_counts(test, prediction="p_default")).select("f1_macro").scalar()
    calf = M.with_f1_metrics(M.confusion_counts(test, prediction="p_cal")).select("f1_macro").scalar()
    return cal.select("calibrated_threshold", dflt.alias("default_threshold_f1"), calf.alias("calibrated_f1")) \
        .withColumn("difference", F.col("calibrated_f1") - F.col("default_threshold_f1"))


_CAL_TEST_CTE = f"""cal_t AS (SELECT calibrated_threshold AS t FROM calib),
cal_c AS ({Q.counts("(SELECT s.label, s.score, c.t FROM scored s CROSS JOIN cal_t c WHERE s.data_type = 'TEST') x", 'CAST(score > t AS INTEGER)')}),
def_c AS ({Q.counts("(SELECT * FROM scored WHERE data_type = 'TEST') x", 'CAST(score > 0.5 AS INTEGER)')}),
calfix AS (
  SELECT (SELECT t FROM cal_t) AS calibrated_threshold,
         (SELECT {Q.F1_MACRO} FROM def_c) AS default_threshold_f1,
         (SELECT {Q.F1_MACRO} FROM cal_c) AS calibrated_f1)"""


@register("calibration_fixed", Q.with_base(
    """SELECT calibrated_threshold, round(default_threshold_f1, 12) AS default_threshold_f1,
       round(calibrated_f1, 12) AS calibrated_f1, round(calibrated_f1 - default_threshold_f1, 12) AS difference
FROM calfix""", _SWEEP_SQL, _CALIB_CTE, _CAL_TEST_CTE, scored=True))
def q_calibration_fixed(spark, sf_dir):
    """A15-A17 + P13 with fixed scores: calibrated on TRAIN, applied to TEST."""
    return _round(calibration_fixed(spark, sf_dir), ["default_threshold_f1", "calibrated_f1", "difference"])


_ROBUST_COLS = ["original_f1_macro", "train_mani_pct", "test_mani_pct", "default_threshold_f1",
                "calibrated_threshold", "calibrated_f1", "kfold_n_runs", "kfold_mean_f1", "kfold_std_f1",
                "kfold_ci_95_lower", "kfold_ci_95_upper", "restrat_n_seeds", "restrat_mean_f1",
                "restrat_std_f1", "restrat_ci_95_lower", "restrat_ci_95_upper"]


@register("robustness_fixed", Q.with_base(
    f"""SELECT round((SELECT f1_macro FROM official), 4) AS original_f1_macro,
       round((SELECT avg(CAST(label AS DOUBLE)) FROM enriched WHERE data_type = 'TRAIN') * 100.0, 1) AS train_mani_pct,
       round((SELECT avg(CAST(label AS DOUBLE)) FROM enriched WHERE data_type = 'TEST') * 100.0, 1) AS test_mani_pct,
       round((SELECT default_threshold_f1 FROM calfix), 4) AS default_threshold_f1,
       round((SELECT calibrated_threshold FROM calfix), 2) AS calibrated_threshold,
       round((SELECT calibrated_f1 FROM calfix), 4) AS calibrated_f1,
       k.n AS kfold_n_runs, round(k.mean, 4) AS kfold_mean_f1, round(k.std, 4) AS kfold_std_f1,
       round(k.ci_lower, 4) AS kfold_ci_95_lower, round(k.ci_upper, 4) AS kfold_ci_95_upper,
       r.n AS restrat_n_seeds, round(r.mean, 4) AS restrat_mean_f1, round(r.std, 4) AS restrat_std_f1,
       round(r.ci_lower, 4) AS restrat_ci_95_lower, round(r.ci_upper, 4) AS restrat_ci_95_upper
FROM (SELECT count(f1_macro) AS n, avg(f1_macro) AS mean, stddev_pop(f1_macro) AS std,
             avg(f1_macro) - 1.96 * stddev_pop(f1_macro) / sqrt(count(f1_macro)) AS ci_lower,
             avg(f1_macro) + 1.96 * stddev_pop(f1_macro) / sqrt(count(f1_macro)) AS ci_upper FROM fold_scores) k
CROSS JOIN (SELECT count(f1_macro) AS n, avg(f1_macro) AS mean, stddev_pop(f1_macro) AS std,
             avg(f1_macro) - 1.96 * stddev_pop(f1_macro) / sqrt(count(f1_macro)) AS ci_lower,
             avg(f1_macro) + 1.96 * stddev_pop(f1_macro) / sqrt(count(f1_macro)) AS ci_upper FROM restrat) r""",
    _FOLDS, Q.fold_scores_cte(), _HOLD, Q.restrat_cte(), Q.official_cte(), _SWEEP_SQL, _CALIB_CTE, _CAL_TEST_CTE,
    scored=True))
def q_robustness_fixed(spark, sf_dir):
    """A19 with fixed scores: the four report sections, flattened, rounded as the reference reports them."""
    dist = M.split_distribution(S.claims(spark, sf_dir))
    cal = calibration_fixed(spark, sf_dir)
    k = M.score_summary(fold_scores(spark, sf_dir))
    r = M.score_summary(restratified_scores(spark, sf_dir))

    def pick(df, c):
        return df.select(c).scalar()

    row = cal.select(
        F.round(official_f1(spark, sf_dir).select("f1_macro").scalar(), 4).alias("original_f1_macro"),
        F.round(dist.filter(F.col("split") == "TRAIN").select("pos_pct").scalar(), 1).alias("train_mani_pct"),
        F.round(dist.filter(F.col("split") == "TEST").select("pos_pct").scalar(), 1).alias("test_mani_pct"),
        F.round("default_threshold_f1", 4).alias("default_threshold_f1"),
        F.round("calibrated_threshold", 2).alias("calibrated_threshold"),
        F.round("calibrated_f1", 4).alias("calibrated_f1"),
        pick(k, "n").alias("kfold_n_runs"), F.round(pick(k, "mean"), 4).alias("kfold_mean_f1"),
        F.round(pick(k, "std"), 4).alias("kfold_std_f1"), F.round(pick(k, "ci_lower"), 4).alias("kfold_ci_95_lower"),
        F.round(pick(k, "ci_upper"), 4).alias("kfold_ci_95_upper"),
        pick(r, "n").alias("restrat_n_seeds"), F.round(pick(r, "mean"), 4).alias("restrat_mean_f1"),
        F.round(pick(r, "std"), 4).alias("restrat_std_f1"),
        F.round(pick(r, "ci_lower"), 4).alias("restrat_ci_95_lower"),
        F.round(pick(r, "ci_upper"), 4).alias("restrat_ci_95_upper"))
    return row.select(*_ROBUST_COLS)


# ---------------------------------------------------------------- prompts at a second shape

_TURN_ZS_SQL = _ZS_SQL.replace("mani_news", "q.text").replace("original_news_article", "a.text")


@register("claim_turn_prompts", f"""SELECT q.conv_id, q.turn, {_TURN_ZS_SQL} AS prompt
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user'""")
def q_claim_turn_prompts(spark, sf_dir):
    """P10 over claim/article pairs from conversations (a user turn and the next turn)."""
    t = S.claim_turns(spark, sf_dir)
    return t.select("conv_id", "turn", P.zero_shot_prompt().alias("prompt"))


@register("logits_evaluate", Q.with_base(
    f"""SELECT c.*, {Q.METRICS}, {Q.MATRIX}, coalesce(a.roc_auc, 0.0) AS roc_auc
FROM ({Q.counts('lg', 'prediction')}) c CROSS JOIN auc a""",
    """lg0 AS (SELECT row_id, label, CAST(row_id % 7 AS DOUBLE) / 4.0 AS l0, score * 3.0 AS l1 FROM scored),
lg AS (SELECT row_id, label, CAST(l1 > l0 AS INTEGER) AS prediction,
              exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS score FROM lg0)""",
    Q.auc_cte("auc", "lg"), scored=True))
def q_logits_evaluate(spark, sf_dir):
    """F2 (metric callback): softmax/argmax of two-class logits -> A11 metrics, AUC 0.0 on failure."""
    s = S.scored(spark, sf_dir).select(
        "label", F.array((F.col("row_id") % 7).cast("double") / 4.0, F.col("score") * 3.0).alias("logits"))
    return _matrix_text(M.evaluate_logits(s))
