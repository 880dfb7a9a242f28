"""Class-balanced linear classifiers on sparse TF-IDF rows.

Two objectives (labels y in {-1, +1}, balanced sample weights s_i = n / (2 n_c)):

* logistic:       0.5 |w|^2 + C sum_i s_i log(1 + exp(-y_i (x_i w + b)))   (b free)
* squared hinge:  0.5 (|w|^2 + b^2) + C sum_i s_i max(0, 1 - y_i (x_i w + b))^2
  (the intercept is an extra feature with value 1, so it is penalised)

Both are minimised by a trust-region Newton method whose linear systems are solved by
conjugate gradients on Hessian-vector products, for any number of runs (folds, seeds) at once,
and always in the same distributed way.  The rows are packed once into blocks of
sparse rows; a run adds its role for every row, an idf vector and a norm for every
row.

* Start: a bounded random sample of the rows (``SAMPLE`` numbers) goes to one task a run, which solves
  the run's problem on it.  The sample only chooses the start; a run ends when its
  gradient over all rows vanishes.
* Pass: one Spark job over the blocks answers what every unfinished run asks for, a
  gradient or a Hessian-vector product, by products of a block and of its transpose with the runs'
  vectors, run after run over a piece of the block that stays in the processor's cache.  A pass's tasks are as many as the entries need, at most the
  cores; their sums meet piece by piece in a JVM aggregate, so the bytes of a pass depend on cores
  and weights, not on the input's partitions.

The driver holds ``HELD`` vectors of runs x features numbers (``MAX_WEIGHTS`` bounds them all), whatever the rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most numbers that the driver holds for the vectors of all runs (point, gradient and those of the conjugate gradients).
MAX_WEIGHTS = 500_000_000
#: Vectors a run holds at once: ten and the ``STEEP`` steepest directions, at half precision.
HELD = 14
#: Directions along which a sample's Hessian is steepest that a run keeps, and products to find them.
STEEP, LANCZOS = 8, 16
#: Numbers in one piece of the sums of a pass.
PIECE = 65536
#: Entries in one block of rows, and at least in the blocks that one task of a pass reads.
BLOCK_ENTRIES = 1_000_000
#: Entries, and rows x runs, of the sample that chooses the start (expected; 192 MB at most).
SAMPLE = 12_000_000
#: Entries of a block that are multiplied with all runs' vectors in turn.
CHUNK = 262_144
#: From so many runs on, a block holds its rows by column too.
MANY = 20


@dataclass(frozen=True)
class LinearSpec:
    loss: str            # 'logistic' or 'squared_hinge'
    C: float
    max_iter: int = 1000     # Newton steps, those of the start included
    gtol: float = 1e-6       # on the objective divided by C x sum of sample weights


# Fixed values of the reference's two classifiers.
LOGREG = LinearSpec("logistic", 1.0)
SVM = LinearSpec("squared_hinge", 0.5, max_iter=2000)


def sigmoid(x):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = 1.0 / (1.0 + np.exp(-x[pos]))
    ex = np.exp(x[~pos])
    out[~pos] = ex / (1.0 + ex)
    return out


def loss_terms(loss: str, z: np.ndarray, y: np.ndarray, s: np.ndarray):
    """(sum of weighted losses, d loss / d z) for margins z."""
    m = y * z
    if loss == "logistic":
        return float(np.sum(s * np.logaddexp(0.0, -m))), -y * s * sigmoid(-m)
    if loss == "squared_hinge":
        v = np.maximum(0.0, 1.0 - m)
        return float(np.sum(s * v * v)), -2.0 * y * s * v
    raise ValueError(f"Unknown loss: {loss}")


def curvature(loss: str, z: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The second derivative of the weighted losses by the margins z."""
    if loss == "logistic":
        p = sigmoid(z)
        return s * p * (1.0 - p)
    if loss == "squared_hinge":
        return 2.0 * s * (y * z < 1.0)
    raise ValueError(f"Unknown loss: {loss}")


def regulariser(loss: str, w: np.ndarray):
    """0.5 |w|^2 (+ b^2 for the squared hinge); w's last entry is b."""
    r = w.copy()
    if loss == "logistic":
        r[-1] = 0.0
    return 0.5 * float(r @ r), r


#: What a run asks of a pass: the objective and gradient at a point, or the Hessian there times a direction.
Ask = tuple[np.ndarray, "np.ndarray | None"]


def steepest(dim: int, seed: int = 0) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The directions along which a Hessian is steepest, by Lanczos' method: yields a direction and is sent its product with
    the Hessian.  Returns (curvatures falling, unit vectors), at most ``STEEP``."""
    v = np.random.default_rng(seed).normal(size=dim)
    basis, products = [v / np.linalg.norm(v)], []
    for _ in range(min(LANCZOS, dim)):
        hv = yield basis[-1]
        products.append(hv)
        left = hv - np.array(basis).T @ (np.array(basis) @ hv)
        left -= np.array(basis).T @ (np.array(basis) @ left)
        length = float(np.linalg.norm(left))
        if length <= 1e-9 * float(np.linalg.norm(hv)):
            break
        basis.append(left / length)
    q, hq = np.array(basis[:len(products)]), np.array(products)
    inside = q @ hq.T
    curvatures, turn = np.linalg.eigh((inside + inside.T) / 2)
    best = np.argsort(-curvatures)[:STEEP]
    return curvatures[best], turn[:, best].T @ q


def newton(x0: np.ndarray, max_iter: int = 1000, gtol: float = 1e-6, least_curvature: float = 1.0, forcing: float = 0.1,
           ftol: float = 1e-13, most_steps: int = 200, steep: tuple[np.ndarray, np.ndarray] | None = None) -> Generator[Ask, tuple[float, np.ndarray] | np.ndarray, tuple]:
    """Minimise a smooth convex function: yields (point, None) and is sent (f, gradient), or yields
    (point, direction) and is sent the Hessian there times the direction.

    Trust-region Newton steps; their systems are solved by conjugate gradients until the residual is
    ``forcing`` times the gradient, or the region's edge is met.  ``steep``, about the steepest directions and their
    curvatures, preconditions them: it changes the way, not the end.  Returns (x, f, gradient, iterations,
    converged): it stops at max |grad| <= gtol, where the model expects a relative decrease below ftol, or
    after ``max_iter`` steps; the first two count as converged."""
    def near(r: np.ndarray) -> np.ndarray:
        if steep is None:
            return r
        along = steep[1] @ r
        return r + (along * (steep[0][-1] / steep[0] - 1.0)) @ steep[1]

    x = x0.astype(float).copy()
    f, g = yield x, None
    radius = float(np.linalg.norm(g)) / least_curvature  # no Newton step is longer
    for it in range(max_iter):
        if np.max(np.abs(g)) <= gtol:
            return x, f, g, it, True
        step, r = np.zeros_like(x), -g
        q = near(r)
        p, rr = q.copy(), float(r @ q)
        stop = forcing * float(np.linalg.norm(r))
        for _ in range(most_steps):
            hp = yield x, p
            php = float(p @ hp)
            if php <= 0.0:
                break
            alpha = rr / php
            longer = step + alpha * p
            if np.linalg.norm(longer) >= radius:
                pp, sp, ss = float(p @ p), float(step @ p), float(step @ step)
                alpha = (-sp + math.sqrt(sp * sp + pp * max(0.0, radius * radius - ss))) / pp
                step, r = step + alpha * p, r - alpha * hp
                break
            step, r = longer, r - alpha * hp
            if float(np.linalg.norm(r)) <= stop or np.max(np.abs(r)) <= 0.3 * gtol:
                break
            q = near(r)
            new = float(r @ q)
            p, rr = q + (new / rr) * p, new
        expected = -0.5 * float(g @ step - step @ r)
        if expected <= ftol * max(abs(f), 1.0):
            return x, f, g, it, True
        fn, gn = yield x + step, None
        actual, length = f - fn, float(np.linalg.norm(step))
        if actual < 0.25 * expected:
            radius = max(0.25 * min(length, radius), 1e-300)
        elif actual > 0.75 * expected:
            radius = max(radius, 2.0 * length)
        if actual > 1e-4 * expected:
            x, f, g = x + step, fn, gn
    return x, f, g, max(0, max_iter), bool(np.max(np.abs(g)) <= gtol)


# ---------------------------------------------------------------- packed rows

TRAIN, TEST = 1, 2
#: A block: its rows by row (ptr, cols, vals), and where several runs share it also by column (used, starts, at, by_col).
BLOCK = ("n int, ptr binary, cols binary, vals binary, norms binary, roles binary, y binary, ids binary, "
         "used binary, starts binary, at binary, by_col binary")
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _by_column(p: np.ndarray, c: np.ndarray, v: np.ndarray, n_runs: int) -> list[np.ndarray]:
    if n_runs < MANY:
        return [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
    order = np.argsort(c, kind="stable")
    used, starts = np.unique(c[order], return_index=True)
    return [used.astype(np.int32), starts.astype(np.int64), np.repeat(np.arange(len(p) - 1, dtype=np.int32), np.diff(p))[order], v[order]]


def _block_row(n: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays)], names=NAMES)


def pack(rows: DataFrame, n_runs: int, idf: np.ndarray | None = None) -> DataFrame:
    """Blocks of sparse rows from (row_id, label, indices, values, roles).

    ``roles`` is a string with one digit a run (0: the run does not use the row, ``TRAIN`` or
    ``TEST``).  With ``idf`` (runs x features) a run's row is values x idf over its own norm;
    without it rows are taken as they are."""
    held = rows.sparkSession.sparkContext.broadcast(None if idf is None else idf * idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ptr = col["indices"].offsets.to_numpy().astype(np.int64)
            cols = col["indices"].values.to_numpy(zero_copy_only=False).astype(np.int32)
            vals = col["values"].values.to_numpy(zero_copy_only=False).astype(np.float64)
            roles = (np.frombuffer("".join(col["roles"].to_pylist()).encode(), dtype=np.int8) - ord("0")).reshape(batch.num_rows, n_runs)
            y = np.where(col["label"].to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            ids = col["row_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0]
            while cuts[-1] < batch.num_rows:
                a = cuts[-1]
                cuts.append(max(a + 1, int(np.searchsorted(ptr, ptr[a] + BLOCK_ENTRIES, side="right")) - 1))
            for a, b in zip(cuts, cuts[1:]):
                p, c, v = ptr[a:b + 1] - ptr[a], cols[ptr[a]:ptr[b]], vals[ptr[a]:ptr[b]]
                norms = np.ones((b - a, n_runs))
                if square is not None:
                    none = _by_column(p, c[:0], v[:0], 0)
                    norms = np.sqrt(Block(b - a, [p, c, v * v, norms, roles[a:b], y[a:b], ids[a:b], *none], n_runs).times(square))
                    norms[norms == 0] = 1.0
                yield _block_row(b - a, [p, c, v, norms, roles[a:b], y[a:b], ids[a:b], *_by_column(p, c, v, n_runs)])

    return rows.select("row_id", "label", "indices", "values", "roles").mapInArrow(run, BLOCK)


class Block:
    """One packed block, opened without copying."""

    TYPES = ("<i8", "<i4", "<f8", "<f8", "i1", "<f8", "<i8", "<i4", "<i8", "<i4", "<f8")

    def __init__(self, n: int, arrays: list[np.ndarray], n_runs: int):
        self.n = n
        self.ptr, cols, self.vals, norms, roles, self.y, self.ids, self.used, self.starts, at, self.by_col = arrays
        self.cols, self.at = cols.astype(np.intp), at.astype(np.intp)   # numpy takes by these without a copy
        self.norms, self.roles = norms.reshape(n, n_runs), roles.reshape(n, n_runs)

    def margins(self, run: int, u: np.ndarray, b: float) -> np.ndarray:
        return self.times(u[None])[:, 0] / self.norms[:, run] + b

    def times(self, u: np.ndarray) -> np.ndarray:
        """rows x k: the rows' products with the k vectors of ``u`` (k x features)."""
        out = np.zeros((len(u), self.n))
        some = np.flatnonzero(np.diff(self.ptr))   # sums of empty rows stay 0
        for seg, entries, starts in _segments(self.ptr[some], len(self.cols)):
            cols, vals, rows, buffer = self.cols[entries], self.vals[entries], some[seg], np.empty(entries.stop - entries.start)
            for v, own in zip(u, out):
                own[rows] = _sums(v, cols, vals, starts, buffer)
        return out.T

    def transposed(self, t: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` (k x features) the columns' products with the k columns of ``t`` (rows x k)."""
        t = np.ascontiguousarray(t.T)
        if not len(self.used):
            lengths = np.diff(self.ptr)
            for v, own in zip(t, out):
                entries = np.repeat(v, lengths)
                entries *= self.vals
                own += np.bincount(self.cols, weights=entries, minlength=len(own))
            return
        for seg, entries, starts in _segments(self.starts, len(self.at)):
            at, vals, cols, buffer = self.at[entries], self.by_col[entries], self.used[seg], np.empty(entries.stop - entries.start)
            for v, own in zip(t, out):
                own[cols] += _sums(v, at, vals, starts, buffer)


def _sums(v: np.ndarray, at: np.ndarray, vals: np.ndarray, starts: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Sums of ``v[at] * vals`` from each of ``starts`` to the next."""
    v.take(at, out=buffer, mode="clip")   # without a mode numpy makes a copy of the buffer
    buffer *= vals
    return np.add.reduceat(buffer, starts)


def _segments(starts: np.ndarray, n: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Runs of whole segments of about ``CHUNK`` entries: (segments, their entries, starts within)."""
    ends = np.append(starts[1:], n)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        yield slice(i, j), slice(int(starts[i]), int(ends[j - 1])), starts[i:j] - starts[i]
        i = j


def blocks_of(batches: Iterator[pa.RecordBatch], n_runs: int) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch.column(0)[row].as_py(), [np.frombuffer(batch.column(i + 1)[row].as_buffer(), dtype=t)
                                                       for i, t in enumerate(Block.TYPES)], n_runs)


# ---------------------------------------------------------------- batched fit

def class_counts(blocks: DataFrame, n_runs: int) -> tuple[np.ndarray, int, int]:
    """(runs x 2: negative and positive training rows, all rows, all entries)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, entries = np.zeros((n_runs, 2), dtype=np.int64), 0, 0
        for b in blocks_of(batches, n_runs):
            train = b.roles == TRAIN
            n[:, 1] += train[b.y > 0].sum(axis=0)
            n[:, 0] += train[b.y < 0].sum(axis=0)
            rows, entries = rows + b.n, entries + len(b.cols)
        yield pa.record_batch([pa.array(np.arange(-1, n_runs)), pa.array(np.append(rows, n[:, 0])), pa.array(np.append(entries, n[:, 1]))],
                              names=["run", "neg", "pos"])

    counts = np.zeros((n_runs + 1, 2))
    for r in blocks.mapInArrow(run, "run long, neg long, pos long").groupBy("run").agg(F.sum("neg"), F.sum("pos")).collect():
        counts[r[0] + 1] = r[1], r[2]
    return counts[1:], int(counts[0, 0]), int(counts[0, 1])


def class_weights(counts: np.ndarray) -> np.ndarray:
    """The balanced weight of a row of each class: rows / (classes present x rows of the class)."""
    present = (counts > 0).sum(axis=1, keepdims=True)
    return np.where(counts > 0, counts.sum(axis=1, keepdims=True) / np.maximum(present * counts, 1), 0.0)


@dataclass
class Problem:
    """What all tasks know of the runs."""
    loss: str
    C: np.ndarray                # of each run
    scale: np.ndarray            # the objective is divided by C x sum of sample weights
    per_class: np.ndarray        # runs x 2 sample weights
    idf: np.ndarray | None       # runs x features

    def shipped(self, asks: dict[int, Ask]) -> tuple:
        """Runs, points and directions in the features' own space, as a pass needs them."""
        runs = np.array(sorted(asks))
        hess = np.array([i for i, r in enumerate(runs) if asks[r][1] is not None], dtype=int)

        def own(vectors, of):
            x = np.array(vectors)
            return (x[:, :-1] if self.idf is None else x[:, :-1] * self.idf[of]), x[:, -1]
        return runs, own([asks[r][0] for r in runs], runs), hess, own([asks[r][1] for r in runs[hess]], runs[hess]) if len(hess) else None

    def add(self, block: Block, shipped: tuple, total: np.ndarray, z: np.ndarray | None = None) -> np.ndarray | None:
        """Adds a block's part to ``total``: a row (features, intercept, loss) for every run asked about.  Takes and
        gives back the margins of the block's rows at the runs' points."""
        runs, (u, b), hess, direction = shipped
        train = block.roles[:, runs] == TRAIN
        if not train.any():
            return None
        norms = block.norms[:, runs]
        y = block.y[:, None]
        s = np.where(train, np.where(y > 0, self.per_class[runs, 1], self.per_class[runs, 0]), 0.0)
        if z is None:
            z = block.times(u) / norms + b
        grad = np.setdiff1d(np.arange(len(runs)), hess)
        t = np.zeros_like(z)
        for i in grad:
            lost, t[:, i] = loss_terms(self.loss, z[:, i], block.y, s[:, i])
            total[i, -1] += lost
        if len(hess):
            q = block.times(direction[0]) / norms[:, hess] + direction[1]
            t[:, hess] = curvature(self.loss, z[:, hess], y, s[:, hess]) * q
        total[:, -2] += t.sum(axis=0)
        block.transposed(t / norms, total[:, :-2])
        return z

    def answers(self, asks: dict[int, Ask], total: np.ndarray) -> dict:
        """What each run is sent, from the sums over all blocks."""
        out = {}
        for sums, r in zip(total, sorted(asks)):
            g = sums[:-1] if self.idf is None else sums[:-1] * np.append(self.idf[r], 1.0)
            point, direction = asks[r]
            if direction is None:
                reg, rg = regulariser(self.loss, point)
                out[r] = self.scale[r] * (reg + self.C[r] * sums[-1]), self.scale[r] * (rg + self.C[r] * g)
            else:
                out[r] = self.scale[r] * (regulariser(self.loss, direction)[1] + self.C[r] * g)
        return out


def _sampled(share: float, n_runs: int):
    """Each row of a block with probability ``share``, drawn from the block's own content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, n_runs):
            take = np.random.default_rng(zlib.crc32(b.ids.tobytes() + b.vals.tobytes())).random(b.n) < share
            if take.any():
                own = np.repeat(take, np.diff(b.ptr))
                p = np.append(0, np.cumsum(np.diff(b.ptr)[take]))
                empty = _by_column(p, b.cols[:0], b.vals[:0], 0)
                yield _block_row(int(take.sum()), [p, b.cols[own].astype(np.int32), b.vals[own], b.norms[take], b.roles[take], b.y[take], b.ids[take], *empty])

    return run


def sample_block(blocks: DataFrame, n_runs: int, rows: int, entries: int) -> Block | None:
    """A random sample of the rows, about ``SAMPLE`` entries and rows x runs, as one block."""
    share = min(1.0, SAMPLE / max(1, entries, rows * n_runs))
    found = list(blocks_of(blocks.mapInArrow(_sampled(share, n_runs), BLOCK).toArrow().to_batches(), n_runs))
    if not found:
        return None
    ptr = np.append(0, np.cumsum(np.concatenate([np.diff(b.ptr) for b in found])))
    parts = [np.concatenate([getattr(b, k) for b in found]) for k in ("cols", "vals", "norms", "roles", "y", "ids")]
    return Block(sum(b.n for b in found), [ptr, *parts, *_by_column(ptr, parts[0][:0], parts[1][:0], 0)], n_runs)


@dataclass
class Start:
    """Where a run begins: its solution on the sample, the Newton steps to it, and if the sample lacks rows the ``steepest`` directions there."""
    point: np.ndarray
    steps: int = 0
    steep: tuple[np.ndarray, np.ndarray] | None = None


def solve_on(block: Block, problem: Problem, run: int, d: int, spec: LinearSpec, whole: bool = True) -> Start:
    """The start of one run from one block, its rows standing for all (``whole``: they are all)."""
    train = block.roles[:, run] == TRAIN
    weight = float(np.where(block.y > 0, problem.per_class[run, 1], problem.per_class[run, 0])[train].sum())
    if not weight:
        return Start(np.zeros(d + 1))
    C = problem.C.copy()
    C[run] = 1.0 / (problem.scale[run] * weight)  # the loss counts as it does over all rows
    own = Problem(problem.loss, C, problem.scale, problem.per_class, problem.idf)
    at, z = None, None

    def answer(ask: Ask):
        nonlocal at, z
        total = np.zeros((1, d + 2))
        # the products of conjugate gradients are all asked for at one point
        z = own.add(block, own.shipped({run: ask}), total, z if at is not None and np.array_equal(at, ask[0]) else None)
        at = ask[0]
        return own.answers({run: ask}, total)[run]

    def end_of(steps: Generator, point: np.ndarray | None = None):
        ask = next(steps)
        while True:
            try:
                ask = steps.send(answer(ask if point is None else (point, ask)))
            except StopIteration as end:
                return end.value

    x, _, _, n, _ = end_of(newton(np.zeros(d + 1), spec.max_iter, spec.gtol, float(problem.scale[run])))
    return Start(x, n, None if whole else end_of(steepest(d + 1, run), x))


def starts(blocks: DataFrame, problem: Problem, runs: list[int], n_runs: int, d: int, spec: LinearSpec, rows: int, entries: int) -> dict[int, Start]:
    """A start for each run from a sample; one task a run."""
    block = sample_block(blocks, n_runs, rows, entries)
    if block is None:
        return {r: Start(np.zeros(d + 1)) for r in runs}
    spark = blocks.sparkSession
    shipped = spark.sparkContext.broadcast((block, problem))
    whole = block.n == rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                s = solve_on(*shipped.value, r, d, spec, whole)
                curvatures, vectors = s.steep or (np.zeros(0), np.zeros((0, d + 1)))
                yield pa.record_batch([pa.array([r]), pa.array([s.point.tobytes()], pa.binary()), pa.array([s.steps]),
                                       pa.array([curvatures.tobytes()], pa.binary()), pa.array([vectors.astype("<f4").tobytes()], pa.binary())],
                                      names=["run", "w", "n", "curvatures", "vectors"])

    tasks = spark.range(0, max(runs) + 1, 1, max(runs) + 1).filter(F.col("id").isin(runs))
    out = {}
    for r in tasks.mapInArrow(run, "run long, w binary, n long, curvatures binary, vectors binary").collect():
        curvatures = np.frombuffer(r["curvatures"], dtype="<f8")
        steep = (curvatures, np.frombuffer(r["vectors"], dtype="<f4").reshape(len(curvatures), d + 1)) if len(curvatures) else None
        out[r["run"]] = Start(np.frombuffer(r["w"], dtype="<f8"), r["n"], steep)
    shipped.destroy()
    return out


def gathered(blocks: DataFrame, entries: int) -> DataFrame:
    """The blocks in as many partitions as their entries need, at most one a core."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.coalesce(max(1, min(cores, -(-entries // BLOCK_ENTRIES))))


def pass_over(blocks: DataFrame, problem: Problem, asks: dict[int, Ask], n_runs: int, d: int) -> dict:
    """One job over all blocks: what every run in ``asks`` is sent.

    Each task adds up its blocks; the sums of all tasks meet piece by piece."""
    # the points are in the features' own space already: tasks need no idf
    shipped = blocks.sparkSession.sparkContext.broadcast((replace(problem, idf=None), problem.shipped(asks)))
    size = len(asks) * (d + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shipped.value
        total = np.zeros((len(asks), d + 2))
        for b in blocks_of(batches, n_runs):
            own.add(b, asked, total)
        flat = total.ravel()
        for i in range(0, size, PIECE):
            if flat[i:i + PIECE].any():
                yield pa.record_batch([pa.array([i // PIECE], pa.int32()), pa.array([flat[i:i + PIECE]], pa.list_(pa.float64()))], names=["piece", "g"])

    summed = blocks.mapInArrow(run, "piece int, g array<double>").groupBy("piece").agg(Summarizer.sum(array_to_vector("g")).alias("g")) \
        .select("piece", vector_to_array("g").alias("g")).toArrow()
    total = np.zeros(size)
    for batch in summed.to_batches():
        for piece, g in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[piece * PIECE:(piece + 1) * PIECE] = g.values.to_numpy()
    shipped.destroy()
    return problem.answers(asks, total.reshape(len(asks), d + 2))


def fit_runs(blocks: DataFrame, n_runs: int, d: int, spec: LinearSpec, idf: np.ndarray | None = None,
             warm: bool = True) -> tuple[np.ndarray, list[dict]]:
    """Fit every run on its training rows -> (runs x (d + 1) weights, intercepts last; info of each run).

    The weights are those of the run's own normalised rows.  All runs step together; a
    finished run takes no further part.  ``warm``: start at the sample's solutions, else at zero.  An info has
    n_train, iterations (Newton steps over all rows), passes (over all rows), grad_max, objective and converged."""
    if n_runs * (d + 1) * HELD > MAX_WEIGHTS:
        raise ValueError(f"{n_runs} runs x {d} features exceed MAX_WEIGHTS; fit fewer runs at once or bound max_features")
    counts, rows, entries = class_counts(blocks, n_runs)
    per_class = class_weights(counts)
    total_weight = (per_class * counts).sum(axis=1)
    problem = Problem(spec.loss, np.full(n_runs, spec.C), 1.0 / (spec.C * np.maximum(total_weight, 1e-300)), per_class, idf)
    weights = np.zeros((n_runs, d + 1))
    infos = [{"n_train": int(counts[r].sum()), "iterations": 0, "passes": 0, "grad_max": 0.0, "objective": 0.0, "converged": False}
             for r in range(n_runs)]
    runs = [r for r in range(n_runs) if total_weight[r] > 0]
    if not runs:
        return weights, infos
    first = starts(blocks, problem, runs, n_runs, d, spec, rows, entries) if warm else {r: Start(np.zeros(d + 1)) for r in runs}
    steps = {r: newton(first[r].point, spec.max_iter - first[r].steps, spec.gtol, float(problem.scale[r]), steep=first[r].steep) for r in runs}
    asks = {r: next(s) for r, s in steps.items()}
    near = gathered(blocks, entries)
    while asks:
        following = {}
        for r, answer in pass_over(near, problem, asks, n_runs, d).items():
            infos[r]["passes"] += 1
            try:
                following[r] = steps[r].send(answer)
            except StopIteration as end:
                x, f, g, it, ok = end.value
                weights[r] = x
                infos[r].update(iterations=it, grad_max=float(np.max(np.abs(g))), objective=float(f), converged=ok)
        asks = following
    return weights, infos
