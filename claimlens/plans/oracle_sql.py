"""DuckDB SQL for the registered queries (the independent oracle).

Each string runs on the pre-registered parquet views.  Shared CTEs are
composed here so every query is a complete, standalone statement.
"""

from __future__ import annotations

from claimlens.functions.text import WHITESPACE_CLASS, ZERO_WIDTH_CLASS
from claimlens.operators.metrics import THRESHOLDS


def norm(x: str) -> str:
    z = f"regexp_replace(coalesce({x}, ''), '{ZERO_WIDTH_CLASS}', '', 'g')"
    z = f"replace({z}, chr(2465) || chr(2492), chr(2524))"
    z = f"replace({z}, chr(2466) || chr(2492), chr(2525))"
    return f"trim(regexp_replace({z}, '{WHITESPACE_CLASS}+', ' ', 'g'))"


RAW = """raw AS (
  SELECT d.doc_id AS row_id,
         trim(split_part(d.text, chr(10), 1)) AS mani_news,
         d.text AS original_news_article,
         CASE WHEN l.quality = 1 THEN 'MANI' ELSE 'NO_MANI' END AS mani_status,
         CASE WHEN l.toxic = 1 THEN split_part(d.text, chr(10), 1) END AS altered_excerpt,
         d.source AS category,
         CASE WHEN (l.quality = 1 AND d.doc_id % 10 = 0) OR (l.quality = 0 AND d.doc_id % 3 = 0)
              THEN 'TEST' ELSE 'TRAIN' END AS data_type
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

NORMED = f"""normed AS (
  SELECT *, {norm('mani_news')} AS _c, {norm('original_news_article')} AS _a,
         {norm('altered_excerpt')} AS _e
  FROM raw WHERE data_type IN ('TRAIN', 'TEST'))"""

ENRICHED = """enriched AS (
  SELECT row_id, data_type,
         CAST(CASE WHEN mani_status = 'MANI' THEN 1 ELSE 0 END AS INTEGER) AS label,
         mani_news, original_news_article, mani_status, altered_excerpt, category,
         '[CLAIM] ' || _c || ' [ARTICLE] ' || _a AS text_sep_token,
         _c || ' ' || _a AS text_concat,
         _c AS text_claim_only,
         CASE WHEN _e <> '' THEN '[CLAIM] ' || _c || ' [EXCERPT] ' || _e
              ELSE '[CLAIM] ' || _c || ' [ARTICLE] ' || _a END AS text_excerpt,
         CAST(length(coalesce(mani_news, '')) AS INTEGER) AS claim_len,
         CAST(length(coalesce(original_news_article, '')) AS INTEGER) AS article_len,
         CAST(altered_excerpt IS NOT NULL AS INTEGER) AS has_excerpt
  FROM normed)"""

SCORED = """scored AS (
  SELECT row_id, data_type, label,
         CAST((35 * label + ((row_id * 7919) % 65)) / 100.0 AS DOUBLE) AS score
  FROM enriched)"""

BASE = ",\n".join([RAW, NORMED, ENRICHED])
BASE_SCORED = ",\n".join([RAW, NORMED, ENRICHED, SCORED])


def with_base(body: str, *extra: str, scored: bool = False) -> str:
    ctes = [BASE_SCORED if scored else BASE, *extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def counts(src: str, pred: str, by: str = "") -> str:
    """Confusion counts over ``src`` with prediction expression ``pred``."""
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {sel}CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN label = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src}{grp}"""


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


F1_POS = ratio("2 * tp", "2 * tp + fp + fn")
F1_NEG = ratio("2 * tn", "2 * tn + fp + fn")
F1_MACRO = (f"(CASE WHEN (CAST(tp + fn + fp > 0 AS INTEGER) + CAST(tn + fp + fn > 0 AS INTEGER)) > 0 "
            f"THEN ({F1_POS} * CAST(tp + fn + fp > 0 AS INTEGER) + {F1_NEG} * CAST(tn + fp + fn > 0 AS INTEGER)) "
            f"/ (CAST(tp + fn + fp > 0 AS INTEGER) + CAST(tn + fp + fn > 0 AS INTEGER)) ELSE 0.0 END)")
F1_WEIGHTED = (f"(CASE WHEN tp + fp + fn + tn > 0 THEN (CAST(tp + fn AS DOUBLE) * {F1_POS} + "
               f"CAST(tn + fp AS DOUBLE) * {F1_NEG}) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END)")
ACCURACY = ratio("tp + tn", "tp + fp + fn + tn")
METRICS = (f"{ACCURACY} AS accuracy, {F1_MACRO} AS f1_macro, {F1_WEIGHTED} AS f1_weighted, "
           f"{F1_POS} AS f1_mani")


MATRIX = "('[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]') AS confusion_matrix"


def auc_cte(name: str, src: str, by: str = "") -> str:
    """Exact tie-aware AUC per group by a plain window over distinct scores."""
    sel = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""{name}_d AS (
  SELECT {sel}score AS _s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS _pos,
         sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS _neg
  FROM {src} GROUP BY {sel}score),
{name}_r AS (
  SELECT {sel}_pos, _neg, _pos * (2 * coalesce(sum(_neg) OVER ({part}ORDER BY _s
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + _neg) AS _u2
  FROM {name}_d),
{name} AS (
  SELECT {sel}CAST(sum(_pos) AS BIGINT) AS n_pos, CAST(sum(_neg) AS BIGINT) AS n_neg,
         CASE WHEN sum(_pos) * sum(_neg) > 0
              THEN CAST(sum(_u2) AS DOUBLE) / CAST(2 * sum(_pos) * sum(_neg) AS DOUBLE) END AS roc_auc
  FROM {name}_r {grp})"""


THRESHOLD_VALUES = ("(VALUES " + ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(THRESHOLDS))
                    + ") AS g(t_idx, threshold)")


def word_grams_cte(src: str = "enriched", text: str = "text_concat", extra: str = "data_type") -> str:
    """Word 1-3 grams per row (one row per occurrence)."""
    def g(n):
        return f"list_transform(range(1, len(k) - {n - 2}), lambda i: array_to_string(k[i:i + {n - 1}], ' '))"
    return f"""tok AS (
  SELECT row_id, {extra}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS k FROM {src}),
grams AS (
  SELECT row_id, {extra}, unnest(list_concat(list_concat(k, {g(2)}), {g(3)})) AS term FROM tok)"""


def char_grams_cte(src: str = "enriched", text: str = "text_concat", extra: str = "data_type") -> str:
    """In-word char 2-5 grams per row (one row per occurrence)."""
    return f"""words AS (
  SELECT row_id, {extra}, ' ' || w || ' ' AS p FROM (
    SELECT row_id, {extra}, unnest(string_split_regex(lower(coalesce({text}, '')), '{WHITESPACE_CLASS}+')) AS w FROM {src})
  WHERE w <> ''),
grams AS (
  SELECT row_id, {extra}, unnest(flatten(list_transform(range(2, least(5, length(p)) + 1),
         lambda n: list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n))))) AS term
  FROM words)"""


def tfidf_ctes(max_features: int) -> str:
    return f"""tf AS (SELECT row_id, data_type, term, CAST(count(*) AS BIGINT) AS tf FROM grams GROUP BY row_id, data_type, term),
ndocs AS (SELECT count(*) AS n FROM enriched WHERE data_type = 'TRAIN'),
v0 AS (
  SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf WHERE data_type = 'TRAIN'
  GROUP BY term HAVING count(*) >= 2 ORDER BY ctf DESC, term LIMIT {max_features}),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx, df, ctf,
         ln((1.0 + CAST(n AS DOUBLE)) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf
  FROM v0 CROSS JOIN ndocs),
raw_w AS (SELECT tf.row_id, tf.term, v.idx, (1.0 + ln(CAST(tf.tf AS DOUBLE))) * v.idf AS _w FROM tf JOIN vocab v USING (term)),
weights AS (SELECT row_id, term, idx, _w / sqrt(sum(_w * _w) OVER (PARTITION BY row_id)) AS weight FROM raw_w)"""


def md5_key(seed: str, row: str = "row_id", salt: str = "") -> str:
    return f"md5(CAST({seed} AS VARCHAR) || ':{salt}' || CAST({row} AS VARCHAR))"


def kfold_cte(name: str, src: str, seeds: str, k: int) -> str:
    """Folds for every seed of ``seeds`` (a VALUES list of seed)."""
    return f"""{name}_cc AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
{name}_st AS (SELECT label, coalesce(sum(n_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {name}_cc),
{name} AS (
  SELECT s.seed, e.row_id, e.label,
         CAST((st.start + row_number() OVER (PARTITION BY s.seed, e.label
               ORDER BY {md5_key('s.seed', 'e.row_id')}, e.row_id) - 1) % {k} AS INTEGER) AS fold
  FROM {src} e CROSS JOIN {seeds} s JOIN {name}_st st ON st.label = e.label)"""


def lit(s: str) -> str:
    """A SQL string literal (newlines kept, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def fold_scores_cte(threshold: float = 0.5) -> str:
    j = "(SELECT f.seed, f.fold, s.label, s.score FROM folds f JOIN scored s USING (row_id)) j"
    return f"""fold_counts AS ({counts(j, f"CAST(score > CAST('{threshold!r}' AS DOUBLE) AS INTEGER)", 'seed, fold')}),
fold_scores AS (SELECT seed, fold, n, {F1_MACRO} AS f1_macro FROM fold_counts)"""


def summary_select(src: str, value: str = "f1_macro", prefix: str = "") -> str:
    return f"""SELECT count({value}) AS {prefix}n, round(avg({value}), 12) AS {prefix}mean,
       round(stddev_pop({value}), 12) AS {prefix}std,
       round(stddev_pop({value}) / sqrt(count({value})), 12) AS {prefix}se,
       round(avg({value}) - 1.96 * (stddev_pop({value}) / sqrt(count({value}))), 12) AS {prefix}ci_lower,
       round(avg({value}) + 1.96 * (stddev_pop({value}) / sqrt(count({value}))), 12) AS {prefix}ci_upper
FROM {src}"""


def official_cte(threshold: float = 0.5, name: str = "official") -> str:
    return f"""{name}_c AS ({counts("(SELECT * FROM scored WHERE data_type = 'TEST') t", f"CAST(score > CAST('{threshold!r}' AS DOUBLE) AS INTEGER)")}),
{name} AS (SELECT {F1_MACRO} AS f1_macro FROM {name}_c)"""


def restrat_cte(threshold: float = 0.5, name: str = "restrat") -> str:
    j = f"(SELECT h.seed, h.role, s.label, s.score FROM holdout h JOIN scored s USING (row_id) WHERE h.role = 'test') j"
    return f"""{name}_c AS ({counts(j, f"CAST(score > CAST('{threshold!r}' AS DOUBLE) AS INTEGER)", 'seed')}),
{name} AS (SELECT seed, {F1_MACRO} AS f1_macro FROM {name}_c)"""
