"""Site and genotype filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_carrier, is_null_gt
from .cluster import carrier_overlap
from .intervals import coverage_fraction, overlap_join, reciprocal_join

# fixed values: thresholds of the evidence-class hard filter
HARD_CUTOFFS = {
    "pe": 3.04, "sr": 2.17, "pesr": 5.21,
    "depth_del": (0.50, 9.41, 0.0), "depth_dup": (0.40, 12.70, 0.11), "gt1kb": (0.30, 3.47, 0.0),
}


def is_biallelic() -> Column:
    return ~((F.col("svtype") == "CNV") | F.col("alt").contains(",") | F.array_contains(F.split("filter", ","), "MULTIALLELIC"))


def drop_empty(sites, genotypes) -> DataFrame:
    """Sites with at least one carrier; multiallelic ones need a copy number other than 2."""
    c = genotypes.where(is_carrier()).select("vid").distinct()
    m = genotypes.where("rd_cn <> 2").select("vid").distinct()
    bi = is_biallelic()
    return sites.where(bi).join(c, "vid", "left_semi").unionByName(sites.where(~bi).join(m, "vid", "left_semi"))


def min_gq_filter(sites, genotypes, rules, global_min: int = 0, max_no_call: float = 0.005, label: str = "COHORT"):
    """Null every non-homozygous genotype below the GQ its (size, AF, type, filter) bucket asks for.

    ``rules`` (cond_id, min_svlen, max_svlen, min_af, max_af, svtypes, filters, ev, min_gq) is a
    small table; list columns are comma separated, null = any. Frequencies are compared on a
    scale of 10000, the first rule by cond_id wins. Returns (genotypes, sites).
    """
    r = rules.withColumn("svtype", F.explode(F.split("svtypes", ",")))
    af = F.least(F.bround(F.col("af") * 10000).cast("long"), F.lit(9999))
    hit = [
        F.col("s.svtype") == F.col("r.svtype"),
        F.col("svlen") >= F.col("min_svlen"), F.col("svlen") < F.col("max_svlen"),
        af >= F.floor(F.col("min_af") * 10000), af < F.ceil(F.col("max_af") * 10000),
        F.col("filters").isNull() | F.arrays_overlap(F.split("filter", ","), F.split("filters", ",")),
    ]
    rule = F.struct("cond_id", "ev", "min_gq")
    per_site = sites.alias("s").join(r.alias("r"), hit).groupBy("vid").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    g = genotypes.join(per_site, "vid", "left")
    fits = F.filter("_rules", lambda x: x["ev"].isNull() | (x["ev"] == F.col("ev")))
    need = F.coalesce(F.try_element_at(fits, F.lit(1))["min_gq"], F.lit(global_min))
    hom = (F.col("a1") == 1) & (F.col("a2") == 1)
    g = g.withColumn("_drop", ~F.coalesce(hom, F.lit(False)) & F.col("gq").isNotNull() & (F.col("gq") < need))
    g = g.withColumns({a: F.when(~F.col("_drop"), F.col(a)) for a in ("a1", "a2")})
    rate = g.groupBy("vid").agg((F.count_if("_drop") / F.count("*")).alias("_r"))
    s = sites.join(rate, "vid", "left").withColumn("min_gq_ncr", F.round("_r", 2))
    s = s.withColumn("filter", F.when(F.col("_r") > max_no_call, add_filter("filter", label)).otherwise(F.col("filter"))).drop("_r")
    return g.drop("_drop", "_rules"), s


def add_filter(col, label: str) -> Column:
    """Add a label to a comma list; PASS disappears as soon as another label is there."""
    tags = F.array_union(F.array_except(F.split(col, ","), F.array(F.lit("PASS"), F.lit(""))), F.array(F.lit(label)))
    return F.array_join(F.array_sort(tags), ",")


def call_rate_filter(sites, genotypes, min_rate: float = 0.85, min_small_del: float = 0.95, drop_labels=("HIGH_SR_BACKGROUND", "HIGH_NOCALL_RATE", "UNRESOLVED")) -> DataFrame:
    """Flag low call rates (stricter for 300 bp - 1 kb deletions), reset QUAL to the carriers' median GQ
    (homozygotes count 99), move some labels out of FILTER, and drop sites without carriers."""
    score = F.when((F.col("a1") > 0) & (F.col("a2") > 0), F.lit(99)).otherwise(F.col("gq"))
    a = genotypes.groupBy("vid").agg(
        F.avg(F.when(is_null_gt(), 0.0).otherwise(1.0)).alias("call_rate"), F.percentile(F.when(is_carrier(), score), F.lit(0.5)).alias("_q"), F.count_if(is_carrier()).alias("_c"),
    )
    s = sites.join(a, "vid").where("_c > 0").withColumn("qual", F.floor("_q").cast("long"))
    kept = F.array_except(F.split("filter", ","), F.array(*[F.lit(x) for x in drop_labels]))
    s = s.withColumn("filter", F.when(F.size(kept) == 0, "PASS").otherwise(F.array_join(F.array_sort(kept), ",")))
    small = (F.col("svtype") == "DEL") & (F.col("svlen") > 300) & (F.col("svlen") < 1000)
    low = F.col("call_rate") < F.when(small, min_small_del).otherwise(min_rate)
    return s.withColumn("filter", F.when(low, add_filter("filter", "LOW_CALL_RATE")).otherwise(F.col("filter"))).drop("_q", "_c")


def large_sr_only(sites, genotypes, size: int = 500, frac: float = 0.1) -> DataFrame:
    """PASS sites above ``size`` whose genotypes rest on split reads alone in too many samples."""
    only = (F.col("rd_cn") == 2) & (F.col("pe_gt") == 0) & (F.col("pe_gq") == 99) & (F.col("sr_gt") != 0)
    f = genotypes.groupBy("vid").agg((F.count_if(only) / F.count("*")).alias("_f"))
    hit = F.array_contains(F.split("filter", ","), "PASS") & (F.col("svlen") > size) & (F.col("_f") > frac)
    return sites.join(f, "vid", "left").withColumn("filter", F.when(hit, "LARGE_SR_ONLY").otherwise(F.col("filter"))).drop("_f")


def common_for_pca(sites, genotypes, min_rate: float = 0.99, min_af: float = 0.01) -> DataFrame:
    """Autosomal PASS sites, well called and common."""
    n = F.sum(F.when(is_null_gt(), 0).otherwise(2))
    ac = F.sum(F.coalesce("a1", F.lit(0)) + F.coalesce("a2", F.lit(0)))
    a = genotypes.groupBy("vid").agg(F.avg(F.when(is_null_gt(), 0.0).otherwise(1.0)).alias("call_rate"), (ac / F.when(n > 0, n)).alias("af"))
    ok = (F.col("filter") == "PASS") & ~F.col("chrom").isin("X", "Y", "chrX", "chrY")
    return sites.where(ok).join(a, "vid").where((F.col("call_rate") >= min_rate) & (F.col("af") >= min_af))


def tag_listed(sites, ids, label: str) -> DataFrame:
    """Add a FILTER label to the listed variants."""
    d = sites.join(ids.select("vid").distinct().withColumn("_l", F.lit(True)), "vid", "left")
    return d.withColumn("filter", F.when(F.col("_l"), add_filter("filter", label)).otherwise(F.col("filter"))).drop("_l")


def score_filter(sites, scores, min_score: float = 0.5) -> DataFrame:
    """Keep scored sites, relabel depth types that were adjudicated as breakends, list supporting classes."""
    d = sites.join(scores, "vid").where(F.col("score") >= min_score)
    breakend = F.col("adj_svtype").isin("BND", "INV", "INS") & F.col("svtype").isin("DEL", "DUP")
    ev = F.filter(F.array(*[F.when(F.col(f"{e.lower()}_prob") >= 0.5, F.lit(e)) for e in ("BAF", "PE", "RD", "SR")]), lambda x: x.isNotNull())
    return d.withColumn("svtype", F.when(breakend, "BND").otherwise(F.col("svtype"))).withColumn("evidence", F.array_join(ev, ","))


def rescue_common(scores, metrics, cutoffs: dict[str, float], rescued: float = 0.51) -> DataFrame:
    """Raise the score of variants with any metric strictly above its cutoff."""
    hit = F.lit(False)
    for m, c in cutoffs.items():
        hit = hit | (F.coalesce(F.col(m), F.lit(float("-inf"))) > c)
    keep = metrics.select("name", hit.alias("_h")).groupBy("name").agg(F.bool_or("_h").alias("_h"))
    return scores.join(keep, "name", "left").withColumn("score", F.when(F.col("_h"), rescued).otherwise(F.col("score"))).drop("_h")


def rewrite_coordinates(sites, metrics, min_log_p: float, min_bg_frac: float) -> DataFrame:
    """Move well supported sites to their split-read positions; drop small CNVs afterwards."""
    m = metrics.select("vid", "sr_sum_log_pval", "sr_sum_bg_frac", "sr_pos_a", "sr_pos_b")
    d = sites.join(m, "vid")
    ok = (F.col("sr_sum_log_pval") >= min_log_p) & (F.col("sr_sum_bg_frac") >= min_bg_frac)
    inv = F.col("svtype") == "INV"
    pos = F.when(inv, F.least("sr_pos_a", "sr_pos_b")).otherwise(F.col("sr_pos_a"))
    end = F.when(inv, F.greatest("sr_pos_a", "sr_pos_b")).otherwise(F.col("sr_pos_b"))
    d = d.withColumns({"_p": F.when(ok, pos).otherwise(F.col("pos")), "_e": F.when(ok, end).otherwise(F.col("stop"))})
    d = d.withColumn("svlen", F.when(ok & ~F.col("svtype").isin("INS", "BND"), F.col("_e") - F.col("_p")).otherwise(F.col("svlen")))
    d = d.withColumn("pos", F.col("_p")).withColumn("stop", F.col("_e"))
    keep = ~(F.col("svtype").isin("DEL", "DUP") & (F.col("svlen") < 50))
    return d.where(keep).select(*sites.columns)


def hard_filter(metrics) -> DataFrame:
    """Variants passing fixed thresholds: depth calls on RD alone, others on PE/SR/both plus RD for CNV over 1 kb."""
    cnv, depth = F.col("svtype").isin("DEL", "DUP"), F.col("algorithms") == "depth"

    def rd(key):
        s, p, q = HARD_CUTOFFS[key]
        return (F.col("rd_median_separation") > s) & (F.col("rd_log_pval") > p) & (F.col("rd_log_2nd_max_p") > q)

    pesr = (F.col("pe_log_pval") > HARD_CUTOFFS["pe"]) | (F.col("sr_log_pval") > HARD_CUTOFFS["sr"]) | (F.col("pe_log_pval") + F.col("sr_log_pval") > HARD_CUTOFFS["pesr"])
    big, size = F.col("svsize") >= 1000, F.col("svsize")
    dep = ((F.col("svtype") == "DEL") & (size > 5000) & rd("depth_del")) | ((F.col("svtype") == "DUP") & (size >= 5000) & rd("depth_dup"))
    cls = F.when(dep, "CNV").when(~depth & pesr & cnv & (rd("gt1kb") & big | ~big), "CNV").when(~depth & pesr, "BCA")
    return metrics.withColumn("pass_class", cls).where("pass_class IS NOT NULL")


def common_sites(sites, carriers, n_samples: int, cnv_size: int) -> DataFrame:
    """Sites carried by more than n/2 - 1 samples; copy-number types only below a size."""
    n = carriers.groupBy("vid").agg(F.count("*").alias("n_carriers"))
    small = ~F.col("svtype").isin("DEL", "DUP") | (F.abs(F.col("stop") - F.col("pos")) < cnv_size)
    return sites.join(n, "vid").where((F.col("n_carriers") > n_samples / 2 - 1) & small)


def carry_filters(clean, filtered, step_failures: list[tuple[DataFrame, str]], default: str) -> DataFrame:
    """Keep FILTER where the site survived, else the label of the step that removed it."""
    d = clean.drop("filter").join(filtered.select("vid", "filter"), "vid", "left")
    label = F.lit(None).cast("string")
    for i, (ids, name) in enumerate(step_failures):
        d = d.join(ids.select("vid").distinct().withColumn(f"_s{i}", F.lit(name)), "vid", "left")
        label = F.coalesce(label, F.col(f"_s{i}"))
    d = d.withColumn("filter", F.coalesce("filter", label, F.lit(default)))
    return d.drop(*[f"_s{i}" for i in range(len(step_failures))])


def apply_edits(sites, genotypes, edits):
    """Curated edit table (name, operation, samples, chrom, start, stop, svtype). Returns (sites, genotypes)."""
    e = edits.withColumn("sample", F.explode(F.split("samples", ",")))
    removed = edits.where("operation = 'remove-variant'").select(F.col("name").alias("vid"))
    new = edits.where("operation IN ('add-variant', 'add-mosaic-variant')")
    mosaic = edits.where("operation IN ('flag-mosaic', 'add-mosaic-variant')").select(F.col("name").alias("vid"), F.col("samples").alias("mosaic"))
    added = new.select(
        F.col("name").alias("vid"), "chrom", F.col("start").alias("pos"), "stop", "svtype",
        F.when(F.col("svtype") == "DEL", "+-").otherwise("-+").alias("strands"), (F.col("stop") - F.col("start")).alias("svlen"),
    )
    base = sites.join(removed, "vid", "left_anti").select(*added.columns)
    s = base.unionByName(added).join(mosaic, "vid", "left")
    het = e.where("operation <> 'remove-variant'").select(F.col("name").alias("vid"), "sample").withColumn("_h", F.lit(True)).distinct()
    g = genotypes.join(removed, "vid", "left_anti").select("vid", "sample", "a1", "a2").join(het, ["vid", "sample"], "full_outer")
    g = g.withColumns({"a1": F.when(F.col("_h"), 0).otherwise(F.col("a1")), "a2": F.when(F.col("_h"), 1).otherwise(F.col("a2"))})
    return s, g.drop("_h")


def flag_samples(sites, bad: DataFrame, label: str) -> DataFrame:
    """Add a label to every row when any sample of a one-sample call set is a QC outlier (scalar flag)."""
    flag = bad.agg((F.count("*") > 0).alias("_bad"))
    d = sites.join(flag, F.lit(True))
    return d.withColumn("filter", F.when(F.col("_bad"), add_filter("filter", label)).otherwise(F.col("filter"))).drop("_bad")


def depth_without_panel_match(calls, panel, frac: float = 0.5) -> DataFrame:
    """Depth calls with no reciprocal match of the same type in the reference panel."""
    geo = panel.select("chrom", "svtype", "start", "stop").distinct()  # one match is enough
    hit = reciprocal_join(calls, geo, frac, how="left_semi").select(F.col("name_a").alias("name")).distinct()
    return calls.join(hit, "name", "left_anti")


def demote_without_depth(sites, raw_depth, min_size: int = 5000, min_cover: float = 0.5) -> DataFrame:
    """Large breakpoint-based CNVs that raw depth calls of the type do not cover become breakends."""
    big = F.col("svtype").isin("DEL", "DUP") & (F.col("svlen") >= min_size)
    c = coverage_fraction(sites.where(big).select("vid", "chrom", "svtype", F.col("pos").alias("start"), "stop"), raw_depth, ["vid"], by=["chrom", "svtype"])
    d = sites.join(c.select("vid", "coverage"), "vid", "left")
    bad = big & (F.coalesce("coverage", F.lit(0.0)) < min_cover)
    return d.withColumn("svtype", F.when(bad, "BND").otherwise(F.col("svtype"))).drop("coverage")


def panel_covered(calls, panel, min_cover: float = 0.5) -> DataFrame:
    """Calls whose span is mostly covered by panel calls with the same allele count (summed overlap / length)."""
    p = overlap_join(calls, panel, by=["chrom", "svtype", "ac"], totals=True)
    s = p.groupBy(F.col("name_a").alias("name"), (F.col("stop_a") - F.col("start_a")).alias("_l")).agg(F.sum("bases_b").alias("_o"))
    return s.withColumn("covered", F.col("_o") / F.col("_l")).where(F.col("covered") >= min_cover).select("name", "covered")


# ---- duplicate breakpoints -------------------------------------------------------------

def support_level() -> Column:
    """Rank 1 (all of PE, SR, RD) .. 8 (none) of a comma list of evidence classes."""
    has = lambda e: F.array_contains(F.split("evidence", ","), e)
    pe, sr, rd = has("PE"), has("SR"), has("RD")
    return (
        F.when(pe & sr & rd, 1).when(pe & rd, 2).when(pe & sr, 3).when(rd & sr, 4).when(pe, 5).when(rd, 6).when(sr, 7).otherwise(8)
    )


def duplicate_breakpoints(sites, carriers, min_share: float = 0.5, cnv_skip: int = 5000) -> DataFrame:
    """Variants to drop: they share a breakend and half of the larger carrier set with a better one.

    Sites need pos, stop, chrom, chr2, strands, svtype, svlen, evidence, algorithms, qual,
    both_end_support, sr_fail. Within one breakend, records with identical carriers are
    first reduced to the best one (their losers are settled there and any pair they form with
    others is implied by the winner's), so copies never make pairs.
    """
    from pyspark.sql import Window

    c = carriers.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("_set"), F.count_distinct("sample").alias("_freq"))
    s = sites.where(~(F.col("svtype").isin("DEL", "DUP") & (F.col("svlen") >= cnv_skip))).join(c, "vid", "left")
    s = s.withColumns({"_set": F.coalesce("_set", F.lit("")), "_freq": F.coalesce("_freq", F.lit(0)).cast("long")})
    rank = F.struct(
        (F.col("svtype") == "BND").alias("k1"), support_level().alias("k2"), (~F.array_contains(F.split("algorithms", ","), "melt")).alias("k3"),
        (-F.col("both_end_support")).alias("k4"), F.col("sr_fail").alias("k5"), (-F.col("qual")).alias("k6"), (-F.col("_freq")).alias("k7"),
        (F.col("svlen") >= 50).alias("k8"), F.col("svlen").alias("k9"), F.col("vid").alias("k10"),
    )
    ends = F.array(
        F.concat_ws("_", "chrom", F.col("pos").cast("string"), F.substring("strands", 1, 1)),
        F.concat_ws("_", "chr2", F.col("stop").cast("string"), F.substring("strands", 2, 1)),
    )
    b = s.select("vid", "_set", "_freq", rank.alias("_rank"), F.explode(F.array_distinct(ends)).alias("_end"))
    best = b.groupBy("_end", "_set").agg(F.min("_rank").alias("_best"))
    same = b.join(best, ["_end", "_set"]).where(F.col("_rank") > F.col("_best")).select("vid")
    reps = b.join(best, ["_end", "_set"]).where(F.col("_rank") == F.col("_best")).select("vid", "_freq", "_rank", "_end")
    x = reps.select([F.col(k).alias(k + "_a") for k in reps.columns])
    y = reps.select([F.col(k).alias(k + "_b") for k in reps.columns])
    pairs = x.join(y, (F.col("_end_a") == F.col("_end_b")) & (F.col("_rank_a") < F.col("_rank_b"))).select("vid_a", "vid_b").distinct()
    lose = carrier_overlap(pairs, carriers).where((F.col("n_both") >= min_share * F.greatest("n_a", "n_b")) & (F.greatest("n_a", "n_b") > 0))
    return same.unionByName(lose.select(F.col("vid_b").alias("vid"))).distinct()
