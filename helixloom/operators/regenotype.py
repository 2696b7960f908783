"""Second genotyping of depth calls: lineage of ids, sites to test again, and replacement of their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bed_cluster

PLACE = ["chrom", "start", "stop", "svtype"]


def site_lineage(raw: DataFrame, merged: DataFrame, frac: float = 0.8) -> DataFrame:
    """(vid, site, cluster, chrom, start, stop, svtype) for every raw id.

    Batches report one place under ids of their own: all ids with one place and type are one ``site``, named by the least of them. The merged call set is
    clustered by reciprocal overlap within its type; a cluster owns the sites of its members, and through them every raw id.
    ``raw`` and ``merged`` have (vid, sample) rows with ``PLACE``.
    """
    calls = merged.where(F.col("svtype").isin("DEL", "DUP")).select(F.col("vid").alias("name"), "sample", *PLACE)
    clustered = bed_cluster(calls, frac).select("cluster", F.explode(F.split("call_name", ",")).alias("vid")).distinct()
    sites = raw.groupBy(*PLACE).agg(F.min("vid").alias("site"), F.collect_set("vid").alias("_ids"))
    ids = sites.select("site", *PLACE, F.explode("_ids").alias("vid"))
    owner = ids.join(clustered, "vid").select("site", "cluster").distinct()
    return ids.join(owner, "site", "left").select("vid", "site", "cluster", *PLACE)


def cluster_samples(raw: DataFrame, lineage: DataFrame) -> DataFrame:
    """Distinct samples and ids of each cluster over all the raw ids that it owns."""
    owned = lineage.where("cluster IS NOT NULL").select("vid", "cluster").distinct()
    return raw.join(owned, "vid").groupBy("cluster").agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct("vid").alias("n_ids"))


def changed_sites(raw: DataFrame, genotyped: DataFrame, min_size: int = 10_000) -> DataFrame:
    """(vid, chrom, start, stop, svtype, n_lost, n_gained): sites over ``min_size`` whose carriers are not the same after genotyping.

    Ids may have changed, so places are compared. Both tables have one row per carrier (a null sample for a site without).
    """
    def carriers(d, mark):
        return d.select(*PLACE, "sample").distinct().withColumn(mark, F.lit(True))

    big = (F.col("stop") - F.col("start") > min_size) & (F.col("svtype") != "CN0")
    before, after = carriers(raw.where(big), "_before"), carriers(genotyped.where(big), "_after")
    both = before.select(*PLACE).distinct().join(after.select(*PLACE).distinct(), PLACE)
    d = before.join(after, [*PLACE, "sample"], "full_outer").where("sample IS NOT NULL").join(both, PLACE, "left_semi")
    n = d.groupBy(*PLACE).agg(F.count_if(F.col("_after").isNull()).alias("n_lost"), F.count_if(F.col("_before").isNull()).alias("n_gained"))
    ids = genotyped.select("vid", *PLACE).distinct()
    return ids.join(n.where("n_lost + n_gained > 0"), PLACE).select("vid", *PLACE, "n_lost", "n_gained")


def sites_to_regenotype(raw: DataFrame, genotyped: DataFrame, lineage: DataFrame, medians: DataFrame, n_samples: int, max_frequency: float = 0.01, max_count: int = 3, min_size: int = 10_000, cohort: DataFrame | None = None) -> DataFrame:
    """Changed sites that are rare in the whole cohort and whose median depth lies next to a copy-number step, not on it.

    ``raw`` are the batch's own sites before genotyping, ``cohort`` (default: the same) those of all batches: a site's cohort count is that of
    its cluster over all of them. ``medians`` has (vid, sample, depth); a site with a missing depth is left out.
    """
    n = cluster_samples(raw if cohort is None else cohort, lineage).select("cluster", "n_samples")
    rare = (F.col("n_samples") / n_samples < max_frequency) | (F.col("n_samples") <= max_count)
    d = changed_sites(raw, genotyped, min_size).join(lineage.select("vid", "cluster").distinct(), "vid").join(n, "cluster").where(rare)
    m = medians.groupBy("vid").agg(F.percentile("depth", F.lit(0.5)).alias("median"), F.bool_or(F.col("depth").isNull()).alias("_gap"))
    m = m.where("NOT _gap AND ((median > 0.85 AND median < 0.97) OR (median > 1.03 AND median < 1.65))")
    return d.join(m.select("vid", "median"), "vid").select("vid", *PLACE, "cluster", "n_samples", "median").distinct()


def replace_records(old: DataFrame, again: DataFrame, listed: DataFrame) -> DataFrame:
    """The call set with the listed ids' records taken from the second genotyping, and gone where that has none."""
    ids = listed.select("vid").distinct()
    fresh = again.join(ids, "vid", "left_semi").select(*old.columns)
    return old.join(ids, "vid", "left_anti").unionByName(fresh)
