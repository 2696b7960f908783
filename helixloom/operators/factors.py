"""Principal components of long matrices and size-balanced clustering of the components.

A matrix is a table (row, col, value); rows grow with the data, columns are the cohort's samples. Components are sought on the
column side. The block of candidate vectors is a table with one row per column; applying the matrix twice is one join of the values
with that table, one sum per matrix row and one sum per column. The values stay partitioned and sorted by row, so a pass shuffles
partial sums only. Only matrices of block size reach the driver: no list of columns, no columns x columns matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

SEED = 17


class Components(NamedTuple):
    vectors: DataFrame  # (col, component, value): unit vectors over the columns
    values: list[float]  # squared singular values, falling
    total: float  # sum of all of them
    residual: float  # largest ||A v - value v|| / largest value


def _block(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _gram(table: DataFrame, k: int, tail: np.ndarray | None = None) -> np.ndarray:
    """Inner products of the k vectors in x (or of x times ``tail``), summed from one small matrix per partition."""

    def run(batches):
        g = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                x = _block(b) if tail is None else _block(b) @ tail
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(g))], ["i", "g"])

    out = np.zeros((k, k))
    parts = table.select("x").mapInArrow(run, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "v"))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _combine(table: DataFrame, turn: np.ndarray) -> DataFrame:
    """The vectors in x times a small matrix."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _block(b) @ turn
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(list(x), pa.list_(pa.float64()))], b.schema.names)

    return settle(table.mapInArrow(run, table.schema))


def principal_components(entries: DataFrame, k: int, row: str | Sequence[str] = "row", col: str = "col", value: str = "value", centre: bool = False, scale: bool = False,
                         n_rows: int | None = None, block: int | None = None, steps: int = 4, tolerance: float = 1e-9, max_rounds: int = 60) -> Components:
    """Leading right singular vectors of the matrix by randomised block Krylov iteration with restarts.

    ``centre`` and ``scale`` refer to columns, as for a correlation matrix; absent entries are zeros then, ``n_rows`` counts the rows
    with all-zero ones (default: the rows that occur). Centring is a rank-one correction: the zeros are never written. Without
    ``centre`` absent entries just don't contribute, which fits rows that were centred over their present entries.

    A round applies the matrix ``steps`` times to a block of ``block`` vectors (8 more than ``k`` unless given) and takes the best
    vectors of all the blocks together; rounds end when the residual of the wanted ones is below ``tolerance``. The residual comes back
    with the result; after ``max_rounds`` it may be larger.
    """
    rows = [row] if isinstance(row, str) else list(row)
    m = entries.select(*rows, F.col(col).alias("_c"), F.col(value).cast("double").alias("_v"))
    n = n_rows if n_rows is not None else m.select(*rows).distinct().count()
    stats = m.groupBy("_c").agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))
    mean = F.col("_s") / n if centre else F.lit(0.0)
    spread = (F.col("_q") - n * mean * mean) / F.lit(float(max(n - 1, 1)))
    sd = F.when(spread > 1e-12, F.sqrt(spread)).otherwise(F.lit(None).cast("double")) if scale else F.lit(1.0)
    cols = settle(stats.select("_c", mean.alias("_m"), sd.alias("_d"), (F.col("_q") - n * mean * mean).alias("_w")).where("_d IS NOT NULL"))
    size, total = cols.agg(F.count("*"), F.sum(F.col("_w") / (F.col("_d") * F.col("_d")))).first()
    k = min(k, size)
    b = min(size, block or k + 8)
    if k == 0 or not total:
        return Components(entries.select(col, F.lit(0).alias("component"), F.lit(0.0).alias("value")).limit(0), [], 0.0, 0.0)
    m = m.repartition(*rows).sortWithinPartitions(*rows).persist()
    w = Window.partitionBy(*rows)

    def apply(table: DataFrame, lo: int, hi: int, by: float) -> DataFrame:
        """x with X'X x[lo:hi] / by appended, X being the centred and scaled matrix."""
        names = [f"t{i}" for i in range(lo, hi)]
        weight = table.selectExpr("_c", "_m", *[f"x[{i}] / _d AS t{i}" for i in range(lo, hi)])
        held = m.join(weight.drop("_m"), "_c")
        shift = [F.lit(0.0)] * len(names)
        if centre:  # one row
            held = held.join(weight.selectExpr(*[f"sum(_m * {t}) AS o{t}" for t in names]), F.lit(True))
            shift = [F.col(f"o{t}") for t in names]
        held = held.select("_c", "_v", *[(F.sum(F.col("_v") * F.col(t)).over(w) - o).alias(t) for t, o in zip(names, shift)])
        back = held.groupBy("_c").agg(*[F.expr(f"sum(_v * {t}) AS {t}") for t in names])
        out = table.join(back, "_c", "left")
        return settle(out.selectExpr("_c", "_m", "_d", "concat(x, array(" + ", ".join(f"coalesce({t} / _d, 0D) / {by!r}D" for t in names) + ")) AS x"))

    q = settle(cols.select("_c", "_m", "_d", F.array(*[F.xxhash64("_c", F.lit(SEED + j)) / float(1 << 63) for j in range(b)]).alias("x")))
    g, top, last = _gram(q, b), float(total), float("inf")
    try:
        for _ in range(max_rounds):
            e, u = np.linalg.eigh(g)
            keep = e > 1e-13 * e[-1]
            q = _combine(q, u[:, keep] / np.sqrt(e[keep]))
            f = int(keep.sum())
            for j in range(steps):
                q = apply(q, j * f, (j + 1) * f, top)
            g = _gram(q, f * (steps + 1))
            s = f * steps
            inner, outer = g[:s, :s], g[:s, f:f + s]
            scale_to = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
            e, u = np.linalg.eigh(inner * np.outer(scale_to, scale_to))
            use = e > 1e-11 * e[-1]
            basis = scale_to[:, None] * u[:, use] / np.sqrt(e[use])
            h = basis.T @ (outer + outer.T) / 2 @ basis
            theta, y = np.linalg.eigh(h)
            theta, best = theta[::-1][:b], basis @ y[:, ::-1][:, :b]
            f, p = len(theta), min(k, len(theta))
            both = np.zeros((len(g), 2 * f))  # the vectors and their images
            both[:s, :f], both[len(g) - s:, f:] = best, best
            q = _combine(q, both)
            rest = np.concatenate([np.diag(-theta)[:, :p], np.eye(f)[:, :p]])
            residual = float(np.sqrt(np.abs(np.diag(_gram(q, p, rest)))).max() / max(theta[0], 1e-300))
            q = _combine(q, np.eye(2 * f)[:, :f])
            g = _gram(q, f)
            if residual <= tolerance or theta[0] <= 0 or last / 4 < residual < 1e-6:  # done, or rounding allows no more
                break
            last = residual
        real = int(sum(t > 1e-11 * theta[0] for t in theta[:k])) if theta[0] > 0 else 0
        norm = 1 / np.sqrt(np.diag(g))
        vectors = _combine(q, (np.eye(f) * norm)[:, :real]).select(F.col("_c").alias(col), F.posexplode("x").alias("component", "value"))
        return Components(settle(vectors), [float(t * top) for t in theta[:real]], float(total), residual)
    finally:
        m.unpersist()


def with_signs(parts: Components, col: str) -> DataFrame:
    """(col, component, value): scores, which are the vectors times their singular values, with the largest one positive."""
    scale = F.element_at(F.array(*[F.lit(e ** 0.5) for e in parts.values]), F.col("component") + 1) if parts.values else F.lit(0.0)
    top = parts.vectors.groupBy("component").agg(F.max_by("value", F.struct(F.round(F.abs("value"), 9), F.col(col))).alias("_t"))
    return parts.vectors.join(top, "component").select(col, "component", (F.col("value") * scale * F.when(F.col("_t") < 0, -1).otherwise(1)).alias("value"))


# ---- clustering ----------------------------------------------------------------------------

def _points(components: DataFrame, key: str) -> DataFrame:
    """(key, p): the components of a sample as one array."""
    return components.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("p"))


def _distances(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Squared distances to all centres; the centres are a literal of clusters x components numbers."""
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centres])
    far = F.transform(c, lambda x: F.aggregate(F.zip_with(x, "p", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d))
    return points.withColumn("d", far)


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    return _distances(points, centres).withColumn("cluster", (F.array_position("d", F.array_min("d")) - 1).cast("int"))


def _means(assigned: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = centres.shape[1]
    new, sizes = centres.copy(), np.zeros(len(centres), int)
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(dims)]).collect():
        new[r["cluster"]], sizes[r["cluster"]] = [r[f"p{i}"] for i in range(dims)], r["n"]
    return new, sizes


def lloyd(points: DataFrame, centres: np.ndarray, max_rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Centres and sizes after Lloyd rounds until nothing moves; an empty cluster keeps its centre."""
    for _ in range(max_rounds):
        new, sizes = _means(_assigned(points, centres), centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres, sizes


def _nearest_means(points: DataFrame, centres: np.ndarray, take: list[int], key: str) -> np.ndarray:
    """For every centre the mean of its ``take`` nearest points (ties by key)."""
    d = _distances(points, centres).select(key, "p", F.posexplode("d").alias("cluster", "dist"))
    want = F.element_at(F.array(*[F.lit(int(t)) for t in take]), F.col("cluster") + 1)
    near = d.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("dist", key))).where(F.col("_r") <= want)
    return _means(near, centres)[0]


def cluster_profiles(components: DataFrame, key: str = "sample", smallest: int = 60, largest: int = 150, ideal: int = 100, patience: int = 10) -> DataFrame:
    """Batches of samples with alike components and sizes between ``smallest`` and ``largest``.

    k = samples / ideal clusters by Lloyd rounds from evenly spaced points along the first component. While a size is out of
    range, every centre moves to the mean of its nearest points, as many as its size should have, and the rounds run again; this
    ends after ``patience`` turns once the centres stand still. At last, samples that fit a too large cluster worst and are among the nearest of a too
    small one change over.
    """
    points = settle(_points(components, key))
    n = points.count()
    k = max(1, round(n / ideal))
    if n == 0:
        return points.select(key, F.lit(0).alias("cluster"))
    order = points.withColumn("_r", F.row_number().over(Window.orderBy(F.col("p")[0], key)))  # one row per sample
    at = [int((2 * i + 1) * n / (2 * k)) + 1 for i in range(k)]
    centres = np.array([r["p"] for r in order.where(F.col("_r").isin(at)).orderBy("_r").collect()], float)
    centres, sizes = lloyd(points, centres)
    target, turn, seen = round(n / k), 0, []
    while ((sizes < smallest) | (sizes > largest)).any() and turn < 10 * patience:
        take = [smallest if s < smallest else largest if s > largest else target for s in sizes]
        moved, sizes = lloyd(points, _nearest_means(points, centres, take, key))
        still = any(np.array_equal(moved, c) for c in seen)  # standing, or going round in a circle
        seen.append(moved)
        centres, turn = moved, turn + 1
        if turn >= patience and still:
            break
    out = settle(_assigned(points, centres))
    small, large = [i for i, s in enumerate(sizes) if s < smallest], [i for i, s in enumerate(sizes) if s > largest]
    if small and large:
        own = out.withColumn("_own", F.element_at("d", F.col("cluster") + 1))
        worst = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("_own"), key))
        own = own.withColumn("_poor", F.col("cluster").isin(large) & (worst <= F.count("*").over(Window.partitionBy("cluster")) - largest))
        d = out.select(key, F.posexplode("d").alias("to", "dist")).where(F.col("to").isin(small))
        good = d.withColumn("_g", F.row_number().over(Window.partitionBy("to").orderBy("dist", key))).groupBy(key).agg(
            F.min_by("to", F.struct("dist", "to")).alias("_to"), F.bool_or(F.col("_g") <= smallest).alias("_good"))
        out = own.join(good, key, "left").withColumn("cluster", F.when(F.col("_poor") & F.col("_good"), F.col("_to")).otherwise(F.col("cluster")))
    return out.select(key, F.col("cluster").cast("int").alias("cluster"))
