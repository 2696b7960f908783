"""Mosaic copy-number events among private calls of parents: passing raw depth tests, but separated less than germline events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bed_cluster
from .coverage import SEX
from .numbering import number_rows

CLASSES = ("reads", "depth_del", "depth_dup")


def mosaic_candidates_by_depth(metrics: DataFrame, cutoffs: dict[str, tuple[float, float]], max_frequency: float = 0.0011, least_second: float = 2.05, max_poor: float = 0.3) -> DataFrame:
    """Names of private parent-only CNVs whose p and second largest p reach the cutoffs of their class, whatever their separation.

    ``metrics`` has name, svtype, algorithms, vf, n_children, rd_log_pval, rd_log_2nd_max_p, poor_region_cov; ``cutoffs`` maps the classes
    reads (not depth alone), depth_del and depth_dup to both cutoffs. Depth-only calls are judged by type, others together.
    """
    kind = F.when(F.col("algorithms") != "depth", "reads").when(F.col("svtype") == "DEL", "depth_del").otherwise("depth_dup")
    d = metrics.where(F.col("svtype").isin("DEL", "DUP") & (F.col("vf") < max_frequency) & (F.col("n_children") == 0)).withColumn("class", kind)
    ok = F.lit(False)
    for c in CLASSES:
        p, second = cutoffs[c]
        ok = ok | ((F.col("class") == c) & (F.col("rd_log_pval") >= p) & (F.col("rd_log_2nd_max_p") >= second))
    return d.where(ok & (F.col("rd_log_2nd_max_p") >= least_second) & (F.col("poor_region_cov") <= max_poor)).select("name", "class")


def mosaic_sites(calls: DataFrame, candidates: DataFrame, min_size: int = 5000, frac: float = 0.8) -> DataFrame:
    """(vid, chrom, start, stop, svtype, samples): autosomal clusters of the candidates' calls with merged coordinates."""
    d = calls.join(candidates.select("name"), "name", "left_semi").where((F.col("stop") - F.col("start") >= min_size) & ~F.col("chrom").isin(SEX))
    c = bed_cluster(d, frac, merge_coordinates=True)
    return c.groupBy(F.col("cluster").alias("vid"), "chrom", "svtype").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))


def mosaic_separation(inner: DataFrame, types: DataFrame) -> DataFrame:
    """Largest separation of carriers and controls over the bins of each event: a mosaic event stands out in no bin."""
    m = inner.groupBy("vid", "grp").agg(F.percentile(F.when(F.col("treat"), F.col("depth")), F.lit(0.5)).alias("_t"), F.percentile(F.when(~F.col("treat"), F.col("depth")), F.lit(0.5)).alias("_c"))
    m = m.join(types.select("vid", "svtype"), "vid").withColumn("_s", F.when(F.col("svtype") == "DEL", F.col("_c") - F.col("_t")).otherwise(F.col("_t") - F.col("_c")))
    return m.groupBy("vid").agg(F.max("_s").alias("separation"))


def below_fence(separations: DataFrame, key: str = "vid", value: str = "separation", width: float = 1.5) -> DataFrame:
    """Rows at or below Q1 - 1.5 (Q3 - Q1). Quartiles are the values of rank n/4 and 3n/4, rounded down; with fewer than four rows there is no
    fence. Ranks come from range partitions, so no task sorts all rows."""
    d = number_rows(separations.where(F.col(value).isNotNull()).select(key, value), [], [value, key], "_n")
    n = d.count()
    if n < 4:
        return separations.limit(0).select(key, value)
    q = d.agg(F.max(F.when(F.col("_n") == n // 4, F.col(value))).alias("a"), F.max(F.when(F.col("_n") == n * 3 // 4, F.col(value))).alias("b")).first()
    return d.where(F.col(value) <= q["a"] - width * (q["b"] - q["a"])).select(key, value)
