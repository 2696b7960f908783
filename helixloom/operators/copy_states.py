"""Copy states of multi-allelic events: one-dimensional k-means over the samples' depths.

The centres start at the multiples of a spacing; of several spacings the one whose clusters are best separated (average silhouette)
is taken. Sorted values make clusters runs, so means and silhouettes are prefix sums. An event is one row with its samples' depths
as a sorted array, so its size is the cohort's; events are spread over the cluster and a batch of them is one call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACINGS = tuple(round(0.1 * i, 1) for i in range(1, 11))


def spaced_clusters(x: np.ndarray, spacing: float, states: int, rounds: int = 100) -> np.ndarray:
    """State of every value of the sorted array: Lloyd rounds from centres 0, spacing, ..., states * spacing.

    A centre without values drops out; of equally near centres (to 1e-9) the lower one takes the value.
    """
    label = np.clip(np.ceil(np.round(x / spacing - 0.5, 9)), 0, states).astype(int)
    for _ in range(rounds):
        kept, index = np.unique(label, return_inverse=True)
        centres = np.bincount(index, x) / np.bincount(index)
        new = kept[np.round(np.abs(x[:, None] - centres), 9).argmin(1)]
        if (new == label).all():
            break
        label = new
    return label


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Average silhouette width of clusters that are runs of the sorted array; lone values and a single cluster give 0."""
    cuts = np.flatnonzero(np.diff(label)) + 1
    if not len(cuts):
        return 0.0
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]])
    run = np.repeat(np.arange(len(lo)), hi - lo)
    total = np.concatenate([[0.0], np.cumsum(x)])
    size, means = hi - lo, (total[hi] - total[lo]) / (hi - lo)
    i = np.arange(len(x))
    below, above = total[i] - total[lo[run]], total[hi[run]] - total[i + 1]
    within = (x * (i - lo[run]) - below + above - x * (hi[run] - i - 1)) / np.maximum(size[run] - 1, 1)
    left = np.where(run > 0, x - means[run - 1], np.inf)
    right = np.where(run < len(lo) - 1, means[np.minimum(run + 1, len(lo) - 1)] - x, np.inf)
    other = np.minimum(left, right)
    widest = np.maximum(within, other)
    width = np.where((size[run] > 1) & (widest > 0), (other - within) / np.where(widest > 0, widest, 1.0), 0.0)
    return float(width.mean())


def best_states(x: np.ndarray, spacings: tuple[float, ...] = SPACINGS, max_states: int = 100) -> tuple[np.ndarray, float, float]:
    """States, spacing and average silhouette of the best spacing (to 1e-6; of equally good ones the widest)."""
    states = min(max_states, len(x) - 1)
    best = None
    for s in spacings:
        label = spaced_clusters(x, s, states)
        width = round(silhouette(x, label), 6)
        if best is None or width >= best[2]:
            best = label, s, width
    return best


def copy_states(depths: DataFrame, spacings: tuple[float, ...] = SPACINGS, max_states: int = 100) -> DataFrame:
    """(vid, sample, depth, state, spacing, separation, n_states) for each sample's depth at each event."""
    d = depths.where("depth IS NOT NULL").groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("depth", "sample"))).alias("s"))
    d = d.select("vid", F.transform("s", lambda s: s["depth"]).alias("x"), F.transform("s", lambda s: s["sample"]).alias("who"))

    def run(batches):
        for b in batches:
            found = [best_states(np.asarray(x, float), spacings, max_states) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("vid"), b.column("x"), b.column("who"), pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()), pa.array([len(np.unique(f[0])) for f in found], pa.int32()),
            ], ["vid", "x", "who", "state", "spacing", "separation", "n_states"])

    kind, who = depths.schema["vid"].dataType.simpleString(), depths.schema["sample"].dataType.simpleString()
    out = d.mapInArrow(run, f"vid {kind}, x array<double>, who array<{who}>, state array<int>, spacing double, separation double, n_states int")
    rows = F.arrays_zip(F.col("who").alias("sample"), F.col("x").alias("depth"), "state")
    return out.select("vid", F.inline(rows), "spacing", "separation", "n_states").select("vid", "sample", "depth", "state", "spacing", "separation", "n_states")
