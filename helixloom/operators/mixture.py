"""Log-likelihood of carriers under a Gaussian mixture of their event's controls (allele-balance deletion test).

Expectation-maximisation with three components per event. An event's control statistics are one array of the cohort's size, sorted
so that sums don't depend on the order of rows; all events of a batch advance in one padded matrix and stop on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, ROUNDS, TOLERANCE, FLOOR = 3, 100, 1e-3, 1e-6


def _log_parts(x, weight, mean, var):
    """log of weight x density: events x values x components."""
    with np.errstate(divide="ignore"):
        return np.log(weight)[:, None] - 0.5 * (np.log(2 * np.pi * var)[:, None] + (x[..., None] - mean[:, None]) ** 2 / var[:, None])


def _log_sum(parts):
    top = parts.max(-1)
    return top + np.log(np.exp(parts - top[..., None]).sum(-1))


def fit_mixtures(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) per event. Means start at the sorted values of rank n/6, n/2 and 5n/6 (rounded down), weights
    equal, variances at the whole variance; rounds end when the mean log-likelihood changes by less than ``TOLERANCE``."""
    n = np.array([len(v) for v in values])
    x, here = np.zeros((len(n), n.max())), np.arange(n.max()) < n[:, None]
    x[here] = np.concatenate(values)
    mean = np.stack([x[np.arange(len(n)), (n * (2 * j + 1)) // (2 * COMPONENTS)] for j in range(COMPONENTS)], 1)
    centre = x.sum(1) / n
    spread = (np.where(here, x - centre[:, None], 0) ** 2).sum(1) / n
    var = np.repeat((spread + FLOOR)[:, None], COMPONENTS, 1)
    weight = np.full(mean.shape, 1 / COMPONENTS)
    last, going = np.full(len(n), -np.inf), np.ones(len(n), bool)
    for _ in range(ROUNDS):
        at = np.flatnonzero(going)
        if not len(at):
            break
        parts = _log_parts(x[at], weight[at], mean[at], var[at])
        score = _log_sum(parts)
        r = np.where(here[at][..., None], np.exp(parts - score[..., None]), 0)
        mass = r.sum(1) + 1e-12
        weight[at] = mass / n[at][:, None]
        mean[at] = (r * x[at][..., None]).sum(1) / mass
        var[at] = (r * (x[at][..., None] - mean[at][:, None]) ** 2).sum(1) / mass + FLOOR
        now = np.where(here[at], score, 0).sum(1) / n[at]
        going[at] = np.abs(now - last[at]) >= TOLERANCE
        last[at] = now
    return weight, mean, var


def mean_log_likelihood(cases: list[np.ndarray], controls: list[np.ndarray]) -> list[float]:
    weight, mean, var = fit_mixtures(controls)
    return [float(_log_sum(_log_parts(c[None], weight[[i]], mean[[i]], var[[i]])).mean()) for i, c in enumerate(cases)]


def deletion_likelihood(statistics: DataFrame, min_controls: int = 10, min_range: float = 1e-4, min_snps: int = 10) -> DataFrame:
    """(vid, del_ratio, loglik, status) of each event from rows (vid, stat, is_case, inside).

    ``stat`` is null where the sample's region looks homozygous anyway. No test is made with too few or too narrow controls, without a usable
    carrier, or with more carriers than controls or too few SNPs; ``status`` says so, and ``del_ratio`` (mean of 10^-stat) and
    ``loglik`` are null then.
    """
    case = F.col("is_case") & F.col("stat").isNotNull()
    ctrl = ~F.col("is_case") & F.col("stat").isNotNull()
    d = statistics.groupBy("vid").agg(
        F.array_sort(F.collect_list(F.when(case, F.col("stat")))).alias("cases"), F.array_sort(F.collect_list(F.when(ctrl, F.col("stat")))).alias("controls"), F.sum("inside").alias("_ns"))
    narrow = (F.size("controls") <= min_controls) | (F.array_max("controls") - F.array_min("controls") < min_range)
    status = F.when(narrow, "ROHregion").when(F.size("cases") == 0, "ROH").when((F.size("cases") > F.size("controls")) | (F.col("_ns") < min_snps), "Potential ROHregion or reference error").otherwise("ok")
    d = d.withColumn("status", status)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                tested = [i for i, s in enumerate(part.column("status").to_pylist()) if s == "ok"]
                cases, controls = part.column("cases").to_pylist(), part.column("controls").to_pylist()
                ratio, score = [None] * part.num_rows, [None] * part.num_rows
                if tested:
                    found = mean_log_likelihood([np.array(cases[i]) for i in tested], [np.array(controls[i]) for i in tested])
                    for i, v in zip(tested, found):
                        ratio[i], score[i] = float((10.0 ** -np.array(cases[i])).mean()), v
                yield pa.RecordBatch.from_arrays([part.column("vid"), pa.array(ratio, pa.float64()), pa.array(score, pa.float64()), part.column("status")], ["vid", "del_ratio", "loglik", "status"])

    kind = statistics.schema["vid"].dataType.simpleString()
    return d.select("vid", "cases", "controls", "status").mapInArrow(run, f"vid {kind}, del_ratio double, loglik double, status string")
