"""Embedding whitening: leading eigenpairs of the covariance by Jacobi-Davidson.

Entries c become the whole numbers x = floor(64 * c) + 1000000. The fit list holds each distinct
vector once, so a vector that a third of the rows repeat weighs no more than another; its mean is
S / n with exact S. The covariance V (divisor n) is never formed: all that the method asks of the
data is the product of V with a few columns, and one pass of Spark gives it, each task summing
(x - S / n)' * ((x - S / n) * B) over its rows, centred before multiplying.

Jacobi-Davidson, for a block of columns at once so that they share the passes:
* Rayleigh-Ritz in the subspace gives Ritz pairs (theta, u) and residuals V u - theta u.
* From the top down, pairs whose residual is down to rounding are locked: their directions leave
  the subspace, and everything after is projected against them.
* The others' correction equations, (I - QQ')(V - theta I)(I - QQ') t = -residual with Q the locked
  and current vectors, are solved by a few steps of MINRES in lockstep, one product a step; t
  extends the subspace.
* A subspace that is full restarts from its best Ritz vectors.

Driver: matrices of (dimensions x subspace); vectors never come there.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out, as
are those whose length isn't the commonest (the longest of equally common ones), or dim if given.
|floor(64 * c)| counts 2**40 at most. Components without variance (under 1e-12 of the largest) aren't
returned; so equal vectors, a single one or an empty table have none. Repeated rows get equal
values; a null id comes through; other columns are not read. Signs make the largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage
from .vectors import is_whole, matrix, scaled, summed

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 2**40
#: Inner steps a correction, growth of the subspace in blocks before a restart, outer steps at most.
INNER, BLOCKS, OUTER = 5, 5, 60
#: Residuals, over the largest eigenvalue: rounding, and what is put up with where rounding is worse.
FINE, COARSE = 64 * np.finfo(float).eps, 1e-10

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension (exact), components (columns), their eigenvalues
    (falling) and residual norms, the trace of the covariance, and the largest entry of |covariance
    of the whitened fit list - identity|."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float


def _mean(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(whole part, rest over n) of each dimension's mean: x - whole is exact."""
    parts = [divmod(s, max(n, 1)) for s in sums]
    return np.array([q for q, _ in parts], np.int64), np.array([r / max(n, 1) for _, r in parts])


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of block add to those of against."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-7]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _corrections(product: Product, q: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for each column's correction equation, all columns a step at a time."""
    project = lambda t: t - q @ (q.T @ t)
    over = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b))), where=b > 0)
    v = project(-residual)
    beta = np.linalg.norm(v, axis=0)
    tiny = 1e-14 * beta
    v, v_old, t = over(v, beta), np.zeros_like(v), np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = project(product(v) - v * theta)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        last, beta = beta, np.linalg.norm(p, axis=0)
        beta = np.where(beta > tiny, beta, 0.0)
        r0, r2, r3 = c * alpha - c_old * s * last, s * alpha + c_old * c * last, s_old * last
        r1 = np.hypot(r0, beta)
        c_old, s_old = c, s
        c, s = over(r0, r1), over(beta, r1)
        w, w_old = over(v - r3 * w_old - r2 * w, r1), w
        t = t + c * eta * w
        eta = -s * eta
        v, v_old = over(p, beta), v
        if not beta.any():
            break
    return project(t)


def leading_eigenpairs(product: Product, dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns; residual norms) of the k largest of a
    symmetric positive semidefinite matrix that is known by its products with blocks of columns.
    RuntimeError if residuals stay over COARSE of the largest eigenvalue."""
    k = min(k, dim)
    width = min(dim, k + max(4, k // 4))
    locked = np.zeros((dim, 0))
    w = _orthonormal(np.random.default_rng(seed).standard_normal((dim, width)), locked)
    vw = product(w)
    largest, best, stuck = 0.0, np.inf, 0
    for _ in range(OUTER):
        h = w.T @ vw
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        w, vw = w @ y, vw @ y
        residual = vw - w * theta
        size = np.linalg.norm(residual, axis=0)
        largest = max(largest, theta[0] if len(theta) else 0.0)
        wanted = k - locked.shape[1]
        worst = size[:wanted].max(initial=0.0)
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        whole = locked.shape[1] + w.shape[1] == dim
        fine = FINE * np.sqrt(dim) * largest
        if (whole or stuck >= 4) and fine < worst <= COARSE * largest:
            fine = worst  # rounding of the sums is all that is left
        n = int(np.argmax(np.append(size[:wanted] > fine, True)))
        if n:
            locked = np.column_stack([locked, w[:, :n]])
            w, vw, theta, residual = w[:, n:], vw[:, n:], theta[n:], residual[:, n:]
            best, stuck = np.inf, 0
        if locked.shape[1] >= k:
            break
        now = min(w.shape[1], width)
        if w.shape[1] + now > BLOCKS * width:  # restart from the best
            w = _orthonormal(w[:, : 2 * width], locked)
            vw = product(w)
            continue
        t = _corrections(product, np.column_stack([locked, w[:, :now]]), theta[:now], residual[:, :now], INNER)
        new = _orthonormal(t, np.column_stack([locked, w]))
        if not new.shape[1]:  # nothing to correct with: a fresh direction
            new = _orthonormal(np.random.default_rng(seed + w.shape[1]).standard_normal((dim, 1)), np.column_stack([locked, w]))
        if new.shape[1]:
            w, vw = np.column_stack([w, new]), np.column_stack([vw, product(new)])
    if locked.shape[1] < k:
        raise RuntimeError(f"{locked.shape[1]} of {k} eigenpairs converged")
    u = np.linalg.qr(locked)[0]
    vu = product(u)
    h = u.T @ vu
    e, y = np.linalg.eigh((h + h.T) / 2)
    e, y = e[::-1], y[:, ::-1]
    u, vu = u @ y, vu @ y
    sign = np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    u, vu = u * sign, vu * sign
    return e, u, np.linalg.norm(vu - u * e, axis=0)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, x) of the rows that count."""
    v = F.col(vector_col)
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(is_whole(F.col("v")))
    if dim is None:
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
        dim = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0] or 0
    return rows.where(F.size("v") == dim).select("id", scaled(F.col("v"), SCALE, LIMIT, OFFSET).alias("x"))


def fit(vectors: DataFrame, k: int = 16) -> Whitening:
    """The whitening of (id, x) rows by up to k components, each distinct x counting once."""
    distinct = stage(vectors.select("x").distinct(), "fit_list")
    counts = summed(distinct, lambda x: np.append(x.sum(0), len(x)), kind="bigint")
    if not len(counts):
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0)
    n, sums = int(counts[-1]), tuple(map(int, counts[:-1]))
    whole, rest = _mean(n, sums)
    dim = len(sums)

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = (x - whole) - rest
            return centred.T @ (centred @ b)

        return summed(distinct, part).reshape(b.shape) / n

    trace = float(summed(distinct, lambda x: (((x - whole) - rest) ** 2).sum()[None])[0]) / n if dim else 0.0
    if trace > 0:
        e, u, residuals = leading_eigenpairs(product, dim, k)
        some = e > 1e-12 * e[0]
        e, u, residuals = e[some], u[:, some], residuals[some]
    else:
        e, u, residuals = np.zeros(0), np.zeros((dim, 0)), np.zeros(0)
    error = 0.0
    if len(e):
        to = u / np.sqrt(e)

        def moments(x: np.ndarray) -> np.ndarray:
            z = ((x - whole) - rest) @ to
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        m = summed(distinct, moments) / n
        mean, second = m[: len(e)], m[len(e) :].reshape(len(e), -1)
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(e))).max())
    drop_stage(distinct)
    return Whitening(n, sums, u, e, residuals, trace, error)


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation: exact sum over dimensions of (n * x - S)**2, whitened: a number for each
    component) of each (id, x) row."""
    n = model.n
    whole, rest = _mean(n, model.sums)
    left = np.array([s % max(n, 1) for s in model.sums], np.int64)
    to = model.components / np.sqrt(model.eigenvalues)

    def run(column: pa.Array) -> pa.Array:
        x = matrix(column)
        if not len(column):
            deviation, z = [], x
        else:
            apart = x - whole
            size = float(n) * float(np.abs(apart).max(initial=0) + 1)
            if size * size * max(apart.shape[1], 1) < 2.0**62:
                deviation = ((n * apart - left) ** 2).sum(1).tolist()
            else:  # beyond 64 bits: Python's whole numbers
                deviation = [sum((n * a - r) ** 2 for a, r in zip(row, left.tolist(), strict=True)) for row in apart.tolist()]
            z = (apart - rest) @ to
        return pa.StructArray.from_arrays(
            [pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0)), pa.array(list(z), pa.list_(pa.float64()))], names=["deviation", "whitened"]
        )

    return vectors.select("id", F.arrow_udf(run, "deviation decimal(38,0), whitened array<double>")("x").alias("w")).select("id", "w.*")


def whiten(rows: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> tuple[DataFrame, Whitening]:
    """(transform of the rows that count, the model fitted on them)."""
    vectors = stage(whole_vectors(rows, id_col, vector_col, dim), "vectors")
    model = fit(vectors, k)
    return transform(vectors, model), model
