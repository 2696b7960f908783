"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

The covariance V of the distinct quantised vectors is never formed. A pass applies it to a block Q of few columns: each partition
of the fit list sends its share of X'(XQ), centred before multiplying, and Spark sums the shares by dimension. A short Lanczos run
bounds the unwanted spectrum from below, the block's least Ritz value bounds it from above; the Chebyshev polynomial of that
interval damps what lies in it. Then QR, one pass, Rayleigh-Ritz, until the residuals certify the wanted pairs. The driver holds
matrices of dimensions x block only. The block starts from a fixed seed.

Defined results: rows without vector or with null or non-finite entries have no result, nor have vectors of another length than
the most frequent one (the longer on ties). Directions without variance have no component, so a constant table has no rows.
Repeated rows keep their own results; extra columns are ignored. A deviation beyond a long is null.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

GUARD = 28  # columns of the block beside the wanted ones
DEGREE = 8
LANCZOS = 8
CERTAIN, ENOUGH = 1e-13, 1e-10  # residual / largest eigenvalue: wanted, and still taken when rounding allows no more


class Fit(NamedTuple):
    n: int
    sums: list[int]  # exact
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    trace: float


def quantised(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` and the long vector x = floor(256 c) of every row with a whole vector of the usual length."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = rows.where(F.coalesce(whole, F.lit(False)))
    usual = held.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    return held.where(F.size(vector) == d).select(*keep, F.transform(v, lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _reach(x: np.ndarray) -> int:
    """The largest absolute entry; the least long has none of its own kind."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact_sums(fit: DataFrame) -> tuple[int, list[int], Fraction]:
    """n, the sum of every dimension and the trace of the covariance, exact."""

    def run(batches):
        n, s, q = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), b.num_rows)
                if _reach(x) >= 1 << 24:
                    x = x.astype(object)
                n, s, q = n + b.num_rows, s + x.sum(0).astype(object), q + (x * x).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(s))), "n": [n] * len(s), "s": [str(v) for v in s], "q": [str(v) for v in q]}, schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("q", pa.string())]))

    wide = "decimal(38,0)"
    rows = fit.mapInArrow(run, "i int, n long, s string, q string").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("s"), F.sum(F.col("q").cast(wide)).alias("q")).orderBy("i").collect()
    if not rows:
        return 0, [], Fraction(0)
    n = rows[0]["n"]
    return n, [int(r["s"]) for r in rows], sum(Fraction(int(r["q"]), n) - Fraction(int(r["s"]), n) ** 2 for r in rows)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once."""
    if _reach(x) < (1 << 52) // n:
        return (x * n - sums.astype(np.int64)) / n
    return ((x.astype(object) * n - sums) / n).astype(float)


def product(fit: DataFrame, n: int, sums: list[int], q: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """V Q by one pass over the fit list, or L'V Q with ``left``."""
    d, k = len(sums) if left is None else left.shape[1], q.shape[1]
    s = np.array(sums, object)

    def run(batches):
        part = np.zeros((d, k))
        for b in batches:
            if b.num_rows:
                y = _centred(_matrix(b.column("x"), b.num_rows), n, s)
                part += (y if left is None else y @ left).T @ (y @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(part[:, j]) for j in range(k))], ["i", *(f"c{j}" for j in range(k))])

    names = [f"c{j}" for j in range(k)]
    rows = fit.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in rows]) / n


def lower_bound(apply, d: int, rng: np.random.Generator) -> float:
    """A bound below the spectrum, as far as a short Lanczos run sees it, and not below zero."""
    v = rng.standard_normal((d, 1))
    basis = [v / np.linalg.norm(v)]
    a, b = [], []
    for _ in range(min(LANCZOS, d)):
        w = apply(basis[-1])
        a.append(float(np.vdot(basis[-1], w)))
        for _ in range(2):
            w = w - sum(u * np.vdot(u, w) for u in basis)
        b.append(float(np.linalg.norm(w)))
        if b[-1] <= 1e-12 * max(abs(x) for x in a):
            break
        basis.append(w / b[-1])
    values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[:len(a) - 1], 1) + np.diag(b[:len(a) - 1], -1))
    return max(0.0, float(values[0] - b[len(a) - 1] * abs(vectors[-1, 0])))


def filtered(apply, x: np.ndarray, vx: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of [low, high] in V, applied to x; ``vx`` is V x."""
    half, centre = (high - low) / 2, (high + low) / 2
    scale = first = half / (top - centre)
    y = (vx - centre * x) * (first / half)
    for _ in range(DEGREE - 1):
        nxt = 1 / (2 / first - scale)
        x, y = y, (apply(y) - centre * y) * (2 * nxt / half) - x * (scale * nxt)
        scale = nxt
    return y


def leading(fit: DataFrame, count: int, seed: int = 11) -> Fit:
    """The ``count`` leading eigenpairs of the covariance of the list's distinct vectors (fewer if its rank is less)."""
    n, sums, trace = exact_sums(fit)
    d = len(sums)
    if not n or not trace:
        return Fit(n, sums, np.zeros(0), np.zeros((d, 0)), float(trace))

    def apply(q):
        return product(fit, n, sums, q)

    rng = np.random.default_rng(seed)
    wanted, k = min(count, d), min(d, count + GUARD)
    low = lower_bound(apply, d, rng) if k < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, k)))[0] if k < d else np.eye(d)
    best = float("inf")
    while True:
        vq = apply(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = q @ turn, vq @ turn
        left = float(np.linalg.norm(vx[:, :wanted] - x[:, :wanted] * values[:wanted], axis=0).max() / values[0])
        if k == d or left <= CERTAIN or left <= ENOUGH and left > best / 2:
            break
        if left > 1e3 * best and best <= ENOUGH:
            raise ArithmeticError(f"the residual grew from {best} to {left}")
        best = min(best, left)
        high = max(values[-1], low + 1e-9 * values[0])
        y = filtered(apply, x, vx, low, high, values[0]) if values[0] > high * (1 + 1e-9) else vx
        q = np.linalg.qr(y)[0]
    real = int((values[:wanted] > 1e-12 * values[0]).sum())
    vectors = np.linalg.qr(x[:, :real])[0]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), range(real)] < 0, -1.0, 1.0)
    return Fit(n, sums, values[:real], vectors, float(trace))


def whiten(rows: DataFrame, count: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row with a whole vector and each component.
    The fit list is settled as a table once; a vector that many rows share is collapsed before the shuffle."""
    x = quantised(rows, vector, [id_col])
    fit_list = write_table(x.select("x").distinct())
    fit = leading(fit_list, count)
    n, sums, k = fit.n, np.array(fit.sums, object), len(fit.values)
    weights = fit.vectors / np.sqrt(fit.values)
    error = float(np.abs(product(fit_list, n, fit.sums, weights, weights) - np.eye(k)).max()) if k else 0.0
    explained = fit.values / fit.trace if k else fit.values

    def run(batches):
        for b in batches:
            if not b.num_rows or not k:
                continue
            held = _matrix(b.column("x"), b.num_rows)
            near = _reach(held) * n + max(abs(int(s)) for s in sums)
            wide = held if near ** 2 * len(sums) < 1 << 62 else held.astype(object)
            dev = ((wide * n - (sums.astype(np.int64) if wide is held else sums)) ** 2).sum(1)
            dev = dev if wide is held else [v if v < 1 << 63 else None for v in dev]
            z = _centred(held, n, sums) @ weights
            ids = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays([
                b.column(id_col).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(ids), n)),
                pa.array(dev, pa.int64()).take(pa.array(ids)), pa.array(z.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(len(ids), error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return x.mapInArrow(run, f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
