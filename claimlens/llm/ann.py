"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order (a bounded sample
of the vectors serves as pivots).  A shard posts its vectors in pivot inverted
files: for each pivot the vectors that have it in their order, with its rank.
A query walks the lists of its own nearest pivots and adds up, for each vector
met, the footrule distance between the two orders (a pivot that one order lacks
counts as last).  The share ``rerank`` of the shard nearest by footrule, and at
least ``LEAST`` candidates for each neighbour asked for, are compared exactly.

Nearness is the inner product, which is not a metric.  Vectors extended by one component that
makes all lengths equal have distances in the order of inner products; as that common
length grows, the pivots p nearest to an extended x are those with the largest x.p - |p|^2 / 2, and those
nearest to an extended query q the ones with the largest q.p.  These orders need no common
length, so one very long vector changes them for no other.  The ``LONGEST`` vectors of a
shard are compared with every query: a long vector can be near to queries that it shares no direction with.

Equal vectors are one entry, with the smallest ids that a result can hold, so
a vector that a third of all rows repeat costs one comparison.  Shards and query
blocks have bounded sizes; every shard meets every block in one co-group, and only
each query's best per shard are shuffled.

Defined results: null or zero vectors, vectors with null, NaN or infinite
components, vectors not of the commonest length (ties: the longer), and rows
with a null id take no part; rows that repeat id and vector count once; a
row is never its own neighbour, nor is another row with its id; an empty table
gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import materialize

PIVOTS = 256
PREFIX = 64
RERANK = 0.15
LEAST = 20
LONGEST = 32
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, v as array<double>."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()
                    & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                    & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n")
    # -0.0 and 0.0 are one value, as they are in inner products
    return good.filter(F.size("v") == size.scalar()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids): each different vector once, with its ``keep`` smallest ids."""
    w = Window.partitionBy("v").orderBy("vec_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep) \
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids")


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int, stored: bool) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each row, nearest first; ``stored`` vectors are not queries."""
    # each side is scaled by itself, so that products of finite components are finite; orders do not change
    scale = np.maximum(np.abs(pivots).max(), 1e-300)
    size = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    p = pivots / scale
    near = (x / size) @ p.T
    if stored:
        near = near - (p * p).sum(axis=1) / 2 * (scale / size)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Pivot inverted files of one shard: for each pivot the vectors that rank it, and their ranks."""

    def __init__(self, perms: np.ndarray, pivots: int):
        n, self.prefix = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.prefix).astype(np.int32)
        self.rank = (order % self.prefix).astype(np.int16)
        self.ends = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.n = n

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's order to every vector of the shard.

        A pivot in both orders costs the difference of its ranks, one in a single order what
        it is short of last; shared pivots lower the sum of both by 2 (prefix - larger rank).
        """
        first, last = self.ends[perm], self.ends[perm + 1]
        lists = list(zip(first.tolist(), last.tolist()))
        vector = np.concatenate([self.vector[a:b] for a, b in lists])
        rank = np.concatenate([self.rank[a:b] for a, b in lists])
        larger = np.maximum(rank, np.repeat(np.arange(len(perm), dtype=np.int16), last - first))
        shared = np.bincount(vector, weights=self.prefix - larger, minlength=self.n)
        return self.prefix * (self.prefix + 1) - 2 * shared


FOUND = "q_rep long, score double, vec_id long"


def _search(k: int, pivots: np.ndarray, prefix: int, rerank: float):
    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"q_rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "vec_id": pd.Series(dtype="int64")})
        x = np.stack(shard["v"].to_numpy()).astype(np.float64)
        y = np.stack(queries["v"].to_numpy()).astype(np.float64)
        files = InvertedFiles(orders(x, pivots, prefix, True), len(pivots))
        perms = orders(y, pivots, prefix, False)
        size = np.linalg.norm(x / np.abs(x).max(), axis=1)
        long = np.argsort(-size, kind="stable")[:LONGEST]
        ids = shard["ids"].to_numpy()
        lengths = np.array([len(i) for i in ids])
        flat, first = np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        take = min(len(x), max(LEAST * (k + 1), int(np.ceil(rerank * len(x)))))
        q_at, found, scores = [], [], []
        for q, perm in enumerate(perms):
            far = files.footrule(perm)
            near = np.union1d(np.argpartition(far, take - 1)[:take], long) if take < len(x) else np.arange(len(x))
            # row by row in one fixed order of summation: equal vectors get equal scores
            score = (x[near] * y[q]).sum(axis=1)
            if len(near) > k + 1:  # ties with the last one stay
                keep = score >= np.partition(score, -(k + 1))[-(k + 1)]
                near, score = near[keep], score[keep]
            q_at.append(np.full(len(near), q))
            found.append(near)
            scores.append(score)
        at, which, score = np.concatenate(found), np.concatenate(q_at), np.concatenate(scores)
        n = lengths[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({"q_rep": np.repeat(queries["rep"].to_numpy()[which], n), "score": np.repeat(score, n),
                             "vec_id": flat[np.repeat(first[at], n) + place]})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX,
           rerank: float = RERANK, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries`` (both as from ``usable``):
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    entries = materialize(classes(vectors, k + 1), "ann-entries")
    asked = materialize(queries.join(entries.select("rep", F.col("v").alias("e_v")), F.col("v") == F.col("e_v"), "left")
                        .select(F.col("vec_id").alias("query_id"), F.coalesce("rep", "vec_id").alias("rep"), "v"), "ann-queries")
    faces = asked.groupBy("rep").agg(F.first("v").alias("v"))  # each different query once
    n, n_queries = entries.count(), faces.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # pivots: a bounded sample, the same however the rows lie
    sample = [r["v"] for r in entries.orderBy(F.xxhash64("rep"), "rep").limit(pivots).collect()]
    p = np.array(sample, dtype=np.float64)
    shards, blocks = -(-n // shard_rows), -(-n_queries // block_queries)
    rows = entries.select("ids", "v", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("long").alias("shard"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = faces.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = rows.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInPandas(
        _search(k, p, min(prefix, len(p)), rerank), FOUND)
    by_face = Window.partitionBy("q_rep").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(by_face)).filter(F.col("place") <= k + 1)
    lists = best.groupBy("q_rep").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    return asked.join(lists, F.col("rep") == F.col("q_rep")).select("query_id", F.slice(
        F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best")) \
        .select("query_id", F.posexplode("best").alias("at", "b")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
