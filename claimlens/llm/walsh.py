"""Centroid clustering with progressive search in Walsh-Hadamard space.

Vectors become integers, floor(``scale`` x component).  The Walsh-Hadamard transform of
an integer vector is integer too, and with D components the squared distance of two
transforms is D times that of the vectors.  A search adds up squared coefficient differences from
coarse to fine (by sequency, in steps that double); the sum so far never exceeds the whole.  After
the first step the closest centroid of each vector is finished to the last coefficient, and
centroids whose sum so far is strictly larger than that distance are eliminated, step by
step; what is left is finished over all coefficients.  Ties go to the smaller number.  No
comparison is approximate: the clusters are those of an exhaustive search.

A round is one job: tasks assign their vectors and add up, for every cluster, rows,
component sums and distances; Spark sums at most clusters x limbs rows a task.  The driver holds
the centroids alone (k x D numbers).  The vectors are written once and read each round;
no vector moves between tasks.

Sums are exact at any size: they travel as limbs of 30 bits, and vectors too large for
64-bit arithmetic are compared in Python integers by the same steps.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite component
take no part; rows that repeat an id or a vector count as often as they occur; a null
id hashes as an empty one; ids that hash alike are ordered by id and components; fewer vectors than
centroids give fewer centroids; an empty cluster keeps its centroid; a distance or sum beyond
a long is null; an empty table gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import materialize

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Integers below this size keep all sums of a comparison within 63 bits.
SMALL = 1 << 20
LIMB = 30


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return v.filter((F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x component) of finite doubles: int64 where all are small, else Python integers."""
    with np.errstate(over="ignore"):
        big = np.floor(x * scale)
    if not big.size or np.abs(big).max() < SMALL:
        return big.astype(np.int64)
    # a product that overflows is that of an integer
    return np.array([[int(b) if math.isfinite(b) else int(a) * scale for a, b in zip(r, s)] for r, s in zip(x.tolist(), big.tolist())],
                    dtype=object).reshape(x.shape)


def sequency(dimensions: int) -> np.ndarray:
    """Places of the transform's coefficients by their number of sign changes."""
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(dimensions)] for i in range(dimensions)])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The exact Walsh-Hadamard transform of each row, coarse coefficients first; the length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x[:, sequency(d)]


def nearest(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, D x squared distance) of each transformed vector, and how many differences were added up."""
    n, d = t.shape
    k = len(c)

    def far(vec, cen, a, b):
        diff = t[vec, a:b] - c[cen, a:b]
        return (diff * diff).sum(axis=1)

    row = np.arange(n)
    vec, cen = np.repeat(row, k), np.tile(np.arange(k), n)
    part = far(vec, cen, 0, 1)
    guess = np.argmin(part.reshape(n, k), axis=1)
    bound = far(row, guess, 0, d)
    done, added = 1, n * k + n * d
    while done < d:
        stay = part <= bound[vec]  # strictly larger sums go
        vec, cen, part = vec[stay], cen[stay], part[stay]
        part = part + far(vec, cen, done, 2 * done)
        added += len(vec) * done
        done *= 2
    # the smallest distance, then the smallest centroid
    stay = part <= bound[vec]
    vec, cen, part = vec[stay], cen[stay], part[stay]
    first = np.concatenate([[True], vec[1:] != vec[:-1]]) if len(vec) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(first)
    best = np.minimum.reduceat(part, at) if len(at) else part
    tie = np.where(part == np.repeat(best, np.diff(np.append(at, len(vec)))), cen, k)
    return (np.minimum.reduceat(tie, at) if len(at) else tie), best, added


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each integer vector."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    cluster, far, _ = nearest(transform(x), transform(centroids))
    return cluster.astype(np.int32), far // x.shape[1]


def limbs(values: list[int]) -> list[list[int]]:
    """Per limb, that part of every number (with its sign), lowest first, as far as any has one."""
    out, rest = [], [abs(v) for v in values]
    while not out or any(rest):
        out.append([(r & ((1 << LIMB) - 1)) * (-1 if v < 0 else 1) for r, v in zip(rest, values)])
        rest = [r >> LIMB for r in rest]
    return out


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int):
    """(ids, integer vectors) of every batch that has rows; small vectors and others apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
        small = np.abs(x).max(axis=1) < SMALL / scale - 1
        for part in (small, ~small):
            if part.any():
                yield ids.filter(pa.array(part)), integers(x[part], scale)


def _sums(centroids: np.ndarray, dimensions: int, scale: int):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * k, np.zeros((k, dimensions), dtype=object)
        for _, x in _batches(batches, dimensions, scale):
            cluster, _ = assign(x, centroids)
            for c in np.unique(cluster):
                own = x[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(axis=0)
        met = [(c, i, n[c] if not i else 0, limb) for c in range(k) if n[c] for i, limb in enumerate(limbs(total[c].tolist()))]
        yield pa.record_batch([pa.array([m[i] for m in met], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                              names=["cluster", "limb", "n", "sums"])

    return run


def update(vectors: DataFrame, centroids: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each cluster's vectors."""
    parts = vectors.mapInArrow(_sums(centroids, dimensions, scale), "cluster int, limb int, n long, sums array<long>")
    summed = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[
        F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dimensions)])
    n, total = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    for r in summed.collect():  # clusters x limbs
        n[r["cluster"]] += r["n"]
        for i in range(dimensions):
            total[r["cluster"]][i] += r[f"s{i}"] << (LIMB * r["limb"])
    new = [[s // n[c] for s in total[c]] if n[c] else centroids[c].tolist() for c in range(len(centroids))]
    return exact(new)


def exact(rows: list[list[int]]) -> np.ndarray:
    """As int64 where all are small, else as Python integers."""
    small = all(abs(v) < SMALL for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if small else object)


def _labels(centroids: np.ndarray, dimensions: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, dimensions, scale):
            cluster, far = assign(x, centroids)
            split = [limbs([f]) for f in far.tolist()]
            yield pa.record_batch([ids, pa.array(cluster), pa.array([[limb[0] for limb in s] for s in split], pa.list_(pa.int64()))],
                                  names=["vec_id", "cluster", "limbs"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(h, "vec_id", "v").limit(k).collect()
    return exact([integers(np.array([r["v"]], dtype=np.float64), scale)[0].tolist() for r in rows])


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
            seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, limbs of the squared distance), final centroids) of ``vectors`` (as from ``usable``)."""
    if dimensions & (dimensions - 1):
        raise ValueError("the number of dimensions must be a power of two")
    rows = materialize(vectors.select("vec_id", "v"), "walsh-vectors")
    centroids = first_centroids(rows, k, seed, scale)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.array().cast("array<long>").alias("limbs")), centroids
    for _ in range(rounds):
        centroids = update(rows, centroids, dimensions, scale)
    labels = rows.mapInArrow(_labels(centroids, dimensions, scale), "vec_id long, cluster int, limbs array<long>")
    return materialize(labels, "walsh-labels"), centroids


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of what ``cluster`` returns."""
    k = len(centroids)
    spread = found.select("cluster", F.posexplode("limbs").alias("limb", "part")) \
        .groupBy("cluster", "limb").agg(F.sum("part").alias("part")).collect()  # clusters x limbs
    inertia = [0] * k
    for r in spread:
        inertia[r["cluster"]] += r["part"] << (LIMB * r["limb"])
    of = found.sparkSession.createDataFrame(
        [(c, _long(inertia[c]), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)],
        "c int, cluster_inertia long, centroid_sha256 string")
    # limbs of 30 bits: two, and 3 bits of a third, make a long
    part = [F.coalesce(F.get("limbs", F.lit(i)), F.lit(0)) for i in range(3)]
    fits = (part[2] < 8) & (F.size("limbs") <= 3)
    distance = F.when(fits, part[0] + F.shiftleft(part[1], LIMB) + F.shiftleft(part[2], 2 * LIMB))
    # k rows
    return found.join(F.broadcast(of), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", distance.alias("distance"), "cluster_inertia", F.lit(_long(sum(inertia))).cast("long").alias("inertia"),
        "centroid_sha256")
