"""Embedding whitening: leading principal components by a block Jacobi-Davidson method.

An entry c becomes the long ``floor(scale * c) + shift``; everything after that is
about these integers. The covariance is never formed. It is only applied to blocks of
vectors: one Spark job computes ``sum (x - mean) ((x - mean) . u)`` over all rows, whose
sums (dimension x block numbers a task) are all that leaves the tasks.

The driver holds a small orthonormal basis (dimension x at most ``basis`` numbers) and
loops:

* Rayleigh-Ritz in the basis gives approximate eigenpairs and their residuals,
* pairs whose residual has reached double precision are locked, the largest first,
  and projected out of all that follows,
* each open pair's correction solves the projected equation
  ``(I - QQ')(V - theta I)(I - QQ') t = -r`` by a few steps of MINRES; the pairs have
  recurrences of their own but share one pass over the rows a step,
* the corrections widen the basis, which is cut back to its best vectors when full.

Locked pairs are the largest: at the end the rest of the basis holds no larger value.

Rows are packed once, many to a row, as 32-bit integers (64-bit where an entry needs it) in
the shared checkpoint folder, so a pass reads them packed and a lost task reruns alone.

Defined results: vectors that are null, hold a null, non-finite or absurdly large (2**52 or
more) entry take no part, and neither do vectors of another length than the commonest one
(ties: the longest) or without entries. Repeated rows and null ids count and are returned. Components whose
eigenvalue is zero to rounding (fewer distinct rows than dimensions) are left out, so one
row alone, or equal rows only, give no result, as does an empty table. ``deviation`` is null
where it does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import saved

LARGEST = float(1 << 52)  # entries beyond it have no exact long
TASK_BYTES = 8 << 20  # packed bytes a task of a pass takes on
GATHER_TASKS = 256  # partial sums of more tasks are added up in Spark before the driver reads them
BLOCK_VALUES = 1 << 20  # numbers that are centred at once
EPS = float(np.finfo(np.float64).eps)

PACKED = "dim int, n int, wide boolean, ids array<long>, x binary, sums array<decimal(38,0)>"


def pack(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Blocks of rows of one length: ids, the integers row by row, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            held = np.maximum(size, 0)
            start = np.cumsum(held) - held
            bad = np.r_[0, np.cumsum(~(np.abs(values) < LARGEST))]
            fine = (size > 0) & (bad[start + held] == bad[start])
            for dim in np.unique(size[fine]).tolist():
                rows = np.nonzero(fine & (size == dim))[0]
                step = max(1, BLOCK_VALUES // dim)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    x = np.floor(values[start[part][:, None] + np.arange(dim)] * scale).astype(np.int64) + shift
                    wide = bool(np.abs(x).max() >= 1 << 31)
                    sums = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dim], pa.int32()),
                            pa.array([len(part)], pa.int32()),
                            pa.array([wide]),
                            pa.array([batch.column(0).take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                            pa.array([(x if wide else x.astype(np.int32)).tobytes()], pa.binary()),
                            pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0))),
                        ],
                        names=["dim", "n", "wide", "ids", "x", "sums"],
                    )

    rows = vectors.select(F.col(vec_id).cast("long"), F.col(vec).cast("array<double>"))
    return saved(rows.mapInArrow(run, PACKED))


@dataclass
class Rows:
    """The packed rows of the fitted length with their exact means ``whole + left / n`` (``rest``: the fraction)."""

    blocks: DataFrame
    tasks: int
    dim: int
    n: int
    whole: np.ndarray
    left: np.ndarray
    rest: np.ndarray


def commonest(packed: DataFrame) -> Rows | None:
    """The rows of the commonest length (ties: the longest); None if there are none."""
    top = packed.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.octet_length("x")).alias("bytes")).orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return None
    own = packed.where(F.col("dim") == top["dim"])
    sums = own.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s").alias("s")).collect()
    total = [int(r["s"]) for r in sorted(sums, key=lambda r: r["pos"])]
    n = int(top["n"])
    tasks = max(1, -(-int(top["bytes"]) // TASK_BYTES))
    whole, left = (np.array(part, np.int64) for part in zip(*(divmod(s, n) for s in total), strict=True))
    return Rows(own.coalesce(tasks), tasks, int(top["dim"]), n, whole, left, left / n)


def _offsets(wide: bool, x: bytes, dim: int, whole: np.ndarray) -> np.ndarray:
    """A block's integers less the whole part of the means."""
    return np.frombuffer(x, np.int64 if wide else np.int32).reshape(-1, dim).astype(np.int64) - whole


def _totals(parts: DataFrame, tasks: int, width: int) -> np.ndarray:
    """The sums over tasks of rows (pos, v): one row for each position and task."""
    if tasks > GATHER_TASKS:
        parts = parts.groupBy("pos").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    got = parts.collect()
    out = np.zeros((max((r["pos"] for r in got), default=-1) + 1, width))
    for r in sorted(got, key=lambda r: (r["pos"], r["v"])):
        out[r["pos"]] += r["v"]
    return out


def _summed(rows: Rows, each: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """``each`` (centred rows -> a matrix) added up over all rows."""
    dim, whole, rest = rows.dim, rows.whole, rows.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for wide, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = each(_offsets(wide, x, dim, whole) - rest)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["pos", "v"]
            )

    return _totals(rows.blocks.select("wide", "x").mapInArrow(run, "pos int, v array<double>"), rows.tasks, width)


def covariance_product(rows: Rows, u: np.ndarray) -> np.ndarray:
    """The covariance (divisor n, centred before multiplying) times a block of vectors."""
    return _summed(rows, lambda c: c.T @ (c @ u), u.shape[1]) / rows.n


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=0))


def _orthonormal(a: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """A basis of the columns' part that is orthogonal to all of ``against``; columns without such a part go."""
    size = _norms(a)
    a = a[:, size > 0] / size[size > 0]
    for _ in range(2):
        for q in against:
            a = a - q @ (q.T @ a)
    if not a.shape[1]:
        return a
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    u = u[:, s > 1e-10]
    for q in against:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, cut: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column: a Lanczos recurrence and Givens rotations each.

    Ends after ``steps`` products or when every residual has shrunk to ``cut`` of its right side.
    """
    size = _norms(b)
    safe = lambda s: np.where(s > 0, s, 1.0)  # noqa: E731 - a finished column divides zeros by one
    beta, v, before = size, b / safe(size), np.zeros_like(b)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c = c_old = np.ones_like(size)
    s = s_old = np.zeros_like(size)
    left = size.copy()
    for _ in range(steps):
        if np.all(np.abs(left) <= cut * size):
            break
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        av = av - alpha * v - beta * before
        after = _norms(av)
        r0 = c * alpha - c_old * s * beta
        r1 = np.sqrt(r0 * r0 + after * after)
        r2 = s * alpha + c_old * c * beta
        r3 = s_old * beta
        w, w_old = (v - r3 * w_old - r2 * w) / safe(r1), w
        open_ = (r1 > 0) & (np.abs(left) > 0)
        c_old, s_old, c, s = c, s, r0 / safe(r1), after / safe(r1)
        x = x + np.where(open_, c * left, 0.0) * w
        left = np.where(open_, -s * left, 0.0)
        before, v, beta = v, av / safe(after), after
    return x


def jacobi_davidson(
    apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, basis: int | None = None, inner: int = 6, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of a symmetric matrix known by its products.

    A pair is locked when its residual is within ``8 sqrt(dim)`` roundings of the largest value, or
    when it is below 1e-12 of it and four rounds on end could not halve it (the products' own rounding).
    """
    wanted = min(wanted, dim)
    basis = min(dim, basis or max(6 * wanted, 20))
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    v = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, min(dim, 2 * wanted))))[0]
    av = apply(v)
    best, stuck = math.inf, 0
    for _ in range(rounds):
        theta, y = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, v, av = theta[order], v @ y[:, order], av @ y[:, order]
        open_ = min(wanted - len(values), len(theta))
        r = av[:, :open_] - v[:, :open_] * theta[:open_]
        r -= locked @ (locked.T @ r)
        size = _norms(r)
        top = max(values.max(initial=0.0), theta[0])
        full = len(values) + len(theta) >= dim
        within = (size <= 8 * math.sqrt(dim) * EPS * top) | ((size <= 1e-12 * top) & (full or stuck >= 4))
        done = open_ if within.all() else int(np.argmin(within))
        if done:
            locked, values = np.hstack([locked, v[:, :done]]), np.r_[values, theta[:done]]
            v, av, theta, r = v[:, done:], av[:, done:], theta[done:], r[:, done:]
            best, stuck = math.inf, 0
        if len(values) == wanted:
            break
        stuck = stuck + 1 if not done and size.max() > best / 2 else 0
        best = min(best, size.max()) if not done else best
        if v.shape[1] + r.shape[1] > basis:
            keep = max(r.shape[1], min(2 * wanted, basis - r.shape[1], v.shape[1]))
            v, av, theta = v[:, :keep], av[:, :keep], theta[:keep]
        shift, q = theta[: r.shape[1]], np.hstack([locked, v[:, : r.shape[1]]])
        project = lambda a, q=q: a - q @ (q.T @ a)
        t = minres(lambda a, shift=shift, p=project: p(apply(p(a)) - shift * p(a)), -project(r), inner, 1e-3)
        t = _orthonormal(np.where(_norms(t) > 0, t, r), locked, v)
        if not t.shape[1]:
            t = _orthonormal(np.random.default_rng(len(values)).standard_normal((dim, 1)), locked, v)
        if t.shape[1]:
            v, av = np.hstack([v, t]), np.hstack([av, apply(t)])
        elif full:  # the basis is everything: only the products' rounding is left
            av = apply(v)
    if len(values) < wanted:
        raise RuntimeError(f"only {len(values)} of {wanted} eigenpairs converged in {rounds} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


@dataclass
class Whitening:
    """A fitted transformation: ``x`` goes to ``(x - mean) . vectors / sqrt(values)``."""

    rows: Rows
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, components: int = 8, vec: str = "embedding", vec_id: str = "vec_id") -> Whitening | None:
    """The whitening by up to ``components`` leading components; None if nothing varies."""
    rows = commonest(pack(vectors, vec, vec_id))
    if rows is None:
        return None
    trace = float(_summed(rows, lambda c: np.array([[float((c * c).sum())]]), 1)[0, 0]) / rows.n
    if not trace > 0:
        return None
    values, directions = jacobi_davidson(lambda u: covariance_product(rows, u), rows.dim, components)
    real = values > 16 * rows.dim * EPS * max(values[0], trace / rows.dim)
    values, directions = values[real], directions[:, real]
    weights = directions / np.sqrt(values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ weights
        return np.vstack([w.sum(axis=0), w.T @ w])

    got = _summed(rows, moments, len(values)) / rows.n
    spread = got[1:] - np.outer(got[0], got[0]) - np.eye(len(values))
    return Whitening(rows, values, directions, trace, float(np.abs(spread).max()))


def whitened(model: Whitening) -> DataFrame:
    """One row per fitted row and component."""
    rows, k = model.rows, len(model.values)
    dim, n, whole, left, rest = rows.dim, rows.n, rows.whole, rows.left, rows.rest
    weights, share, error = model.vectors / np.sqrt(model.values), model.values / model.trace, model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        if (n * (int(np.abs(x).max()) + 1)) ** 2 * dim < 1 << 63:
            return ((n * x - left) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - left.astype(object)) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide, ids, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = _offsets(wide, x, dim, whole)
                at = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(at), n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(at)),
                        pa.array(((x - rest) @ weights).ravel()),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(at), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.blocks.select("wide", "ids", "x").mapInArrow(run, OUTPUT)


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Fit on all usable rows, then every row's whitened components."""
    model = fit(vectors, components)
    return vectors.sparkSession.createDataFrame([], OUTPUT) if model is None else whitened(model)
