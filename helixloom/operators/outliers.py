"""Per-sample variant counts and outlier samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_svtypes(carriers: DataFrame, sites: DataFrame, samples: DataFrame, by=("svtype",)) -> DataFrame:
    """Carried variants per sample and type, zero filled over the samples x observed types grid."""
    by = list(by)
    n = carriers.join(sites.select("vid", *by), "vid").groupBy("sample", *by).agg(F.count("*").alias("n"))
    types = n.select(*by).distinct().agg(F.array_sort(F.collect_set(F.struct(*by))).alias("_t"))
    grid = samples.select("sample").distinct().join(types, F.lit(True)).select("sample", F.inline("_t"))
    return grid.join(n, ["sample", *by], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def iqr_outliers(counts: DataFrame, k: float = 3.0, min_median: float = 0.0, by=("svtype",)) -> DataFrame:
    """Rows strictly outside Q1 - k*IQR .. Q3 + k*IQR of their type, where the median is high enough."""
    by = list(by)
    q = counts.groupBy(*by).agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    q = q.where(F.col("_q")[1] >= min_median).select(*by, (F.col("_q")[0] - k * iqr).alias("lower"), (F.col("_q")[2] + k * iqr).alias("upper"))
    return counts.join(q, by).where((F.col("n") < F.col("lower")) | (F.col("n") > F.col("upper")))


def sd_outliers(counts: DataFrame, k: float = 5.0, by=("chrom", "svtype"), zeros: bool = False) -> DataFrame:
    """Rows outside median +- k*sd of their stratum; optionally every zero count."""
    by = list(by)
    m = counts.groupBy(*by).agg(F.percentile("n", F.lit(0.5)).alias("median"), F.stddev_samp("n").alias("sd"))
    d = counts.join(m, by)
    out = (F.col("n") > F.col("median") + k * F.col("sd")) | (F.col("n") < F.col("median") - k * F.col("sd"))
    return d.where(out | (F.col("n") == 0) if zeros else out)


def exclude_samples(genotypes: DataFrame, outliers: DataFrame) -> DataFrame:
    """Drop the genotypes of outlier samples and the variants that no carrier supports any more."""
    kept = genotypes.join(outliers.select("sample").distinct(), "sample", "left_anti")
    alive = kept.where("coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0").select("vid").distinct()
    return kept.join(alive, "vid", "left_semi")
