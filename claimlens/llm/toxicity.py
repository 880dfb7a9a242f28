"""Toxicity by classifier chains.

Categories are judged one after another; the model of a later category gets the
probabilities of the earlier ones as features.  While learning, those are
out-of-fold: a row's probability comes from a model that has not seen the row,
so later models meet them as uncertain as they are on new text.

Features: whether the text holds each of the words, and of the word beginnings
(``STEM`` letters, for inflected and compound words), that go with a category
beyond chance (chi-squared over all labelled texts, above what the best of as many
unrelated words would reach) and by an effect that does not grow with the rows (the
confidence bound of the log-odds, nearer to 0, at least ``EFFECT`` from it); all such
words, however many; measures of style that do not grow with the text; and, for each
category, the largest and the smallest such bound of the words that the text holds.
Those bounds come from all labelled texts, so a word too rare for the bounded sample
counts as much as the sample shows for words of its strength.  Models are logistic
regressions over sparse rows.

Term statistics cover all labelled documents.  The models fit on a bounded
sample of labelled rows, about ``SAMPLE`` of each class of the last category: those whose
hash lies below sample / rows of the hash's range.  Folds of one step are fitted in
parallel, each from that sample.

Labels are broadcast to the texts up to ``BROADCAST_LABELS`` rows, so that no text moves;
beyond that the join shuffles both sides.

Defined results: null text is the empty text; labelled rows with a null label
teach nothing about that category; a category with a single class among its labels gets
that class's probability 0 or 1 for all; without labels every probability is 0;
rows are judged one by one, so null or repeated ids and repeated rows are kept; labels
that repeat an id count once, by their largest values; an empty table gives no
rows; columns beside the named ones are ignored.
"""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import materialize

#: (category, expression over the columns of labels), in the order of the chain.
CHAIN = [("low_quality", "1 - quality"), ("toxic", "toxic")]
#: A word whose log-odds may be nearer to 0 than this is no feature.
EFFECT = 0.25
#: What a term's own weight costs, in rows; the strongest terms' bounds cost little.
OWN = 0.1
#: Standard errors from the log-odds to its bound.
ERRORS = 2.0
SAMPLE = 4000
FOLDS = 5
THRESHOLD = 0.5
#: A word that fewer labelled documents hold is no feature.
LEAST_DOCUMENTS = 5
#: Letters of a word beginning.
STEM = 4
#: Most label rows that are broadcast (some 50 MB).
BROADCAST_LABELS = 1_000_000
WORDS = r"[\p{L}\p{N}]+"

_WORD = re.compile(r"[^\W_]+")


def style(text: str, words: list[str]) -> list[float]:
    """Shares between 0 and 1: capitals, digits, signs, different words, very short and very long words."""
    n, w = max(1, len(text)), max(1, len(words))
    ascii_text = text.encode("utf-8", "replace")
    upper = len(re.findall(rb"[A-Z]", ascii_text))
    digit = len(re.findall(rb"[0-9]", ascii_text))
    sign = len(re.findall(rb"[^\w\s.,\x80-\xff]", ascii_text))
    return [upper / n, digit / n, sign / n, len(set(words)) / w, sum(len(x) < 3 for x in words) / w, sum(len(x) > 14 for x in words) / w]


def features(text: str, terms: dict[str, int], bounds: np.ndarray) -> tuple[list[int], list[float]]:
    """Numbers of the terms that the whole text holds; its style and its strongest terms by ``bounds`` (terms x categories)."""
    words = _WORD.findall(text.lower())
    met = set(words)
    met |= {w[:STEM] + "-" for w in met if len(w) > STEM}
    at = sorted(terms[w] for w in met if w in terms)
    held = bounds[at]
    return at, [*style(text, words), *held.max(axis=0, initial=0.0).tolist(), *held.min(axis=0, initial=0.0).tolist()]


# ---------------------------------------------------------------- learning

def labelled(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> DataFrame:
    """(h, text, y0, y1, ...) of the documents with labels."""
    marks = labels.select(F.col("doc_id").alias("l_id"), *[F.expr(e).cast("double").alias(f"y{i}") for i, (_, e) in enumerate(chain)]) \
        .groupBy("l_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(chain))])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = materialize(marks, "toxicity-labels")
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return rows.join(marks, F.col("doc_id") == F.col("l_id")).select(
        F.xxhash64("doc_id", "text").alias("h"), "text", *[f"y{i}" for i in range(len(chain))])


def choose_terms(rows: DataFrame, categories: int) -> tuple[list[str], np.ndarray]:
    """All words that tell something about a category, over all labelled documents, and the bounds
    of their log-odds (words x categories; 0 where a word tells nothing)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))
    stems = F.array_distinct(F.transform(F.filter(found, lambda w: F.length(w) > STEM),
                                         lambda w: F.concat(F.substring(w, 1, STEM), F.lit("-"))))
    words = rows.select(F.explode(F.concat(found, stems)).alias("word"), *[f"y{i}" for i in range(categories)])
    sums = words.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"p{i}") for i in range(categories)],
                                     *[F.count(f"y{i}").alias(f"n{i}") for i in range(categories)])
    total = rows.agg(*[F.sum(f"y{i}").alias(f"p{i}") for i in range(categories)],
                     *[F.count(f"y{i}").alias(f"n{i}") for i in range(categories)]).first()
    kept = materialize(sums.filter(F.col("n") >= LEAST_DOCUMENTS), "toxicity-terms")
    chance = 2 * math.log(max(2, kept.count())) + 4
    bounds = []
    for i in range(categories):
        p, n = total[f"p{i}"] or 0.0, total[f"n{i}"] or 0
        if not 0 < p < n:
            bounds.append(F.lit(0.0))
            continue
        a, m = F.col(f"p{i}"), F.col(f"n{i}")
        expected = m * F.lit(p / n)
        chi = (a - expected) * (a - expected) / (expected * F.lit(1 - p / n) + F.lit(1e-9))
        cells = [a + 0.5, m - a + 0.5, F.lit(p + 0.5) - a, F.lit(n - p + 0.5) - (m - a)]
        odds = F.log(cells[0]) - F.log(cells[1]) - F.log(cells[2]) + F.log(cells[3])
        least = F.abs(odds) - ERRORS * F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
        bounds.append(F.when((chi > chance) & (least >= EFFECT), F.signum(odds) * least).otherwise(0.0))
    told = kept.select("word", F.array(*bounds).alias("bounds")).filter(F.exists("bounds", lambda b: b != 0)).collect()
    told.sort(key=lambda r: r["word"])
    return [r["word"] for r in told], np.array([r["bounds"] for r in told]).reshape(len(told), categories)


class _Rows:
    """Rows of a matrix: ones at the places ``at``, then the columns of ``rest``."""

    def __init__(self, at: list, n_terms: int, rest: np.ndarray):
        self.sizes = np.array([len(a) for a in at], dtype=np.int64)
        self.cols = np.concatenate([np.asarray(a, dtype=np.int64) for a in at]) if len(at) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(at)), self.sizes)
        self.n_terms, self.rest = n_terms, rest

    def __len__(self) -> int:
        return len(self.rest)

    def __getitem__(self, keep: np.ndarray) -> _Rows:
        ends = np.cumsum(self.sizes)
        return _Rows([self.cols[ends[i] - self.sizes[i]:ends[i]] for i in np.arange(len(self))[keep]], self.n_terms, self.rest[keep])

    def beside(self, column: np.ndarray) -> _Rows:
        """The same rows with a column more."""
        out = copy.copy(self)
        out.rest = np.column_stack([self.rest, column])
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], minlength=len(self)) + self.rest @ w[self.n_terms:]

    def sums(self, v: np.ndarray) -> np.ndarray:
        """The columns' sums, each row times its ``v``."""
        return np.concatenate([np.bincount(self.cols, v[self.row], minlength=self.n_terms), self.rest.T @ v])


def logistic(x: _Rows, y: np.ndarray, sw: np.ndarray, penalty: float = 0.01, own: float = OWN, rounds: int = 100) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression over rows of weight ``sw``, by L-BFGS.

    A term's own weight costs ``own`` average rows, as there may be more terms than rows.
    """
    z = x.beside(np.ones(len(x)))
    sign = np.where(y > 0.5, 1.0, -1.0)
    ridge = np.full(z.n_terms + z.rest.shape[1], penalty)
    ridge[:z.n_terms] = own * sw.mean()
    ridge[-1] = 0.0

    def loss(w):
        m = sign * z.times(w)
        value = (sw * np.logaddexp(0, -m)).sum() + 0.5 * (ridge * w * w).sum()
        return value, z.sums(-sw * sign / (1 + np.exp(np.minimum(m, 500)))) + ridge * w

    w = np.zeros(len(ridge))
    f, g = loss(w)
    past: list = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-4 * max(1.0, len(y) / 1000):
            break
        q, alphas = g.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, t, r), a in zip(past, reversed(alphas)):
            q += (a - r * (t @ q)) * s
        step, slope = 1.0, g @ q
        while True:
            new, ng = loss(w - step * q)
            if new <= f - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if step < 1e-8:
            break
        s, t = -step * q, ng - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        w, f, g = w - step * q, new, ng
    return w


def probability(w: np.ndarray, x: _Rows) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -500, 500)))


@dataclass
class Model:
    categories: list[str]
    terms: list[str]
    bounds: np.ndarray  # of the terms' log-odds, terms x categories
    weights: list  # of each category, over terms, style, strongest terms and earlier probabilities

    def scores(self, at: list[int], rest: list[float]) -> list[float]:
        n, out = len(self.terms), []
        for w in self.weights:
            if np.isscalar(w):
                out.append(float(w))
                continue
            z = w[at].sum() + np.dot(w[n:-1], [*rest, *out]) + w[-1]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def _fit_fold(category: int, n_terms: int):
    """A fold's model leaves the fold out and judges it; fold -1's learns from all rows and is the one kept."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fold = int(rows["run"].iat[0])
        rows = rows.sort_values("h", kind="stable").reset_index(drop=True)
        x = _Rows(list(rows["at"]), n_terms, np.column_stack([np.stack(list(rows["style"])), *(rows[f"o{j}"].to_numpy(float) for j in range(category))]))
        y = rows[f"y{category}"].to_numpy(float)
        learn = (rows["fold"].to_numpy() != fold) & ~np.isnan(y)
        one_class = learn.sum() == 0 or y[learn].min() == y[learn].max()
        constant = float(y[learn].max()) if learn.any() else 0.0
        w = None if one_class else logistic(x[learn], y[learn], rows["share"].to_numpy(float)[learn])
        own = np.flatnonzero(rows["fold"].to_numpy() == fold)
        p = np.full(len(own), constant) if w is None else probability(w, x[own])
        out = [(int(rows["row"].iat[i]), float(v), None) for i, v in zip(own, p)]
        if fold == -1:
            out.append((-1, constant, None if w is None else w.tolist()))
        return pd.DataFrame(out, columns=["row", "p", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    k = len(chain)
    rows = labelled(docs, labels, chain)
    words, bounds = choose_terms(rows, k)
    number = {w: i for i, w in enumerate(words)}
    # the bounded sample: hashes are uniform, so a bound on them is a share of the rows
    last = f"y{k - 1}"
    # each row weighs what its class has in the corpus, so probabilities are those of the corpus
    keep, share = F.lit(False), F.lit(1.0)
    for value, n in rows.groupBy(last).count().collect():  # two classes and null
        bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * sample // n)
        own = F.col(last).eqNullSafe(F.lit(value))
        keep = keep | (own & (F.col("h") <= F.lit(bound)))
        share = F.when(own, max(1.0, n / sample)).otherwise(share)
    chosen = rows.filter(keep).select("*", share.alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), number, bounds) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array([g[0] for g in got], pa.list_(pa.int32())),
                                   pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["h", *batch.schema.names[2:], "at", "style"])

    ys = "".join(f", y{i} double" for i in range(k))
    table = chosen.mapInArrow(run, f"h long{ys}, share double, at array<int>, style array<double>")
    place = F.row_number().over(Window.orderBy("h", *[f"y{i}" for i in range(k)]))  # over the bounded sample
    table = materialize(table.withColumn("row", place).withColumn("fold", F.pmod(F.col("row"), F.lit(folds))), "toxicity-sample")
    weights: list = []
    for c in range(k):
        runs = table.withColumn("run", F.explode(F.array(*[F.lit(f) for f in range(-1, folds)])))
        fitted = materialize(runs.groupBy("run").applyInPandas(_fit_fold(c, len(words)), "row int, p double, weights array<double>"), "toxicity-fold")
        kept = fitted.filter("row = -1").collect()
        weights.append((np.array(kept[0]["weights"]) if kept[0]["weights"] is not None else kept[0]["p"]) if kept else 0.0)
        if c + 1 < k:
            table = materialize(table.join(fitted.select(F.col("row").alias("f_row"), F.col("p").alias(f"o{c}")),
                                           F.col("row") == F.col("f_row")).drop("f_row"), "toxicity-sample")
    return Model([c for c, _ in chain], words, bounds, weights)


# ---------------------------------------------------------------- prediction

def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each, and <category> booleans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(model.terms)}
        for batch in batches:
            got = [model.scores(*features(t.as_py() or "", number, model.bounds)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), *[pa.array([g[i] for g in got], pa.float64()) for i in range(len(model.categories))]],
                                  names=["doc_id", *[f"p_{c}" for c in model.categories]])

    schema = "doc_id long" + "".join(f", p_{c} double" for c in model.categories)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema) \
        .select("*", *[(F.col(f"p_{c}") >= threshold).alias(c) for c in model.categories])
