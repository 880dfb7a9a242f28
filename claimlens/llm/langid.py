"""Language identification by nearest centroids.

A text becomes a vector of hashed byte n-grams (one to three bytes of its
lower-cased letters, words set apart by a blank): logarithmic counts weighted
by inverse document frequency, of length one.  Every language has several
centroids, found by spherical k-means; the language of the centroid with the
largest cosine is predicted, and the cosine is the score.  A text is rejected if its
cosine lies below ``slack`` times a low quantile (``QUANTILE``) of the cosines that the
training texts of the predicted language have with their own centroids.  A quantile
does not fall as rows are added, as a minimum does, and at least one text of each
language lies below it, so one odd labelled text loosens nothing.

Document frequencies, class sizes and rejection quantiles (read from histograms of
``BINS`` bins a language, summed over the tasks) come from all training texts; k-means alone fits on a bounded sample, about ``sample`` different texts a language: those
whose hash lies below sample / different texts of the hash's range, and that with the smallest hash in any case.  A text that many rows
repeat counts once there, so copies neither fill the sample nor keep a language out of it.  Centroids are languages x centroids x dimensions numbers (64 KB a
language); ``MAX_LANGUAGES`` bounds what is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and counts as rejected; training rows with null text, null language or no letter teach nothing;
without any training text everything is ``und``; null ids are never held out;
rows are judged one by one, so repeats are kept; an empty table gives no
rows; columns beside the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 2000
ROUNDS = 10
SLACK = 0.5
#: Share of a language's training texts that may lie below what ``slack`` is taken of.
QUANTILE = 0.01
#: Cosines between 0 and 1 are counted in so many bins.
BINS = 256
MAX_LANGUAGES = 1000
UNDETERMINED = "und"

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _letter():
    import regex
    return regex.compile(r"\p{L}")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and how often each occurs."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    blank = b == 32
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))]  # one blank between words
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    grams = np.concatenate([b, two + np.uint32(1 << 25), three + np.uint32(1 << 26)])
    slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - int(DIMENSIONS).bit_length() + 1)
    n = np.bincount(slots, minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the n-grams at ``at``, of length one (all zero if none weighs anything)."""
    w = (1 + np.log(n)) * idf[at]
    length = np.sqrt((w * w).sum())
    return (w / length if length else w).astype(np.float32)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32(id as text) falls in the fold that is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


# ---------------------------------------------------------------- learning

def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and texts with each n-gram, over all of ``train``; a task sums its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[counts(t.as_py())[0]] += 1
                n += 1
        yield pa.record_batch([pa.array(np.arange(-1, DIMENSIONS, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], names=["i", "n"])

    rows = train.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in rows:  # DIMENSIONS + 1 of them
        df[r["i"] + 1] = r["n"]
    return int(df[0]), df[1:]


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest row, each next one the row farthest from all before."""
    mean = x.mean(axis=0)
    first = int(np.argmax(x @ mean))
    centres = [x[first]]
    best = x @ x[first]
    for _ in range(1, min(k, len(x))):
        # among the farther half, so that single odd texts do not become centres
        order = np.argsort(best, kind="stable")
        pick = int(order[len(order) // 4])
        centres.append(x[pick])
        best = np.maximum(best, x @ x[pick])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _fit_language(idf: np.ndarray, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
        for i, t in enumerate(rows.sort_values(["h", "text"])["text"]):
            at, n = counts(t)
            x[i, at] = vector(at, n, idf)
        c = kmeans(x, k)
        return pd.DataFrame({"lang": rows["lang"].iat[0], "centroid": [r.tolist() for r in c]})

    return run


@dataclass
class Model:
    langs: list[str]         # of each centroid
    centroids: np.ndarray    # centroids x DIMENSIONS
    idf: np.ndarray
    bounds: np.ndarray       # of each centroid: a smaller cosine is rejected

    @property
    def least(self) -> float:
        """The smallest cosine that some language accepts."""
        return float(self.bounds.min()) if len(self.bounds) else 0.0


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a language and a letter."""
    train = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n, df = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not n:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(0))
    h = F.xxhash64("text")
    sizes = train.groupBy("lang").agg(F.approx_count_distinct(h).alias("texts"), F.min(h).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # hashes are uniform, so a bound on them is a share of a language's texts
    bounds = F.create_map(*[x for lang, texts, least in sizes for x in (
        F.lit(lang), F.lit(max(least, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * sample // max(1, texts)))))])
    chosen = train.select("lang", "text", h.alias("h")).filter(F.col("h") <= F.try_element_at(bounds, F.col("lang"))) \
        .groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies meet in their own tasks first
    rows = chosen.groupBy("lang").applyInPandas(_fit_language(idf, centroids), "lang string, centroid array<float>") \
        .collect()
    rows.sort(key=lambda r: r["lang"])
    model = Model([r["lang"] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float32), idf, np.zeros(len(rows)))
    low = low_cosines(train, model)
    model.bounds = np.array([slack * low.get(lang, 0.0) for lang in model.langs])
    return model


def _cosines(model: Model, text: str) -> np.ndarray:
    at, n = counts(text)
    return model.centroids[:, at] @ vector(at, n, model.idf)


def _histograms(model: Model):
    own = {lang: [i for i, x in enumerate(model.langs) if x == lang] for lang in set(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {lang: np.zeros(BINS, dtype=np.int64) for lang in own}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in own:
                    c = float(_cosines(model, text.as_py())[own[lang]].max())
                    n[lang][min(BINS - 1, max(0, int(c * BINS)))] += 1
        met = [(lang, int(b), int(counted[b])) for lang, counted in n.items() for b in np.flatnonzero(counted)]
        yield pa.record_batch([pa.array([m[0] for m in met], pa.string()), pa.array([m[1] for m in met], pa.int32()),
                               pa.array([m[2] for m in met], pa.int64())], names=["lang", "bin", "n"])

    return run


def low_cosines(train: DataFrame, model: Model, quantile: float = QUANTILE) -> dict[str, float]:
    """By language, the cosine (the lower edge of its bin) that the share ``quantile`` of all its texts lie below, and one at least."""
    rows = train.select("lang", "text").mapInArrow(_histograms(model), "lang string, bin int, n long") \
        .groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # at most languages x BINS
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["lang"], np.zeros(BINS, dtype=np.int64))[r["bin"]] = r["n"]
    out = {}
    for lang, n in found.items():
        below = min(int(n.sum()) - 1, max(1, math.ceil(quantile * int(n.sum()))))
        out[lang] = int(np.searchsorted(np.cumsum(n), below, side="right")) / BINS
    return out


# ---------------------------------------------------------------- prediction

def predict_text(model: Model, text: str | None, letter) -> tuple[str, float, bool]:
    """(language, score, rejected)."""
    if not model.langs or text is None or not letter.search(text):
        return UNDETERMINED, 0.0, True
    c = _cosines(model, text)
    i = int(np.argmax(c))
    return model.langs[i], float(min(1.0, max(0.0, c[i]))), bool(c[i] < model.bounds[i])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` (which must not include the new names) and lang_pred, score, rejected."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letter()
        for batch in batches:
            found = [predict_text(model, t.as_py(), letter) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                                   pa.array([f[2] for f in found], pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """The rows of op8: learn from the documents that are not held out, predict all."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.filter(~held_out(F.col("doc_id"))))
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score", "rejected")
