"""Binned coverage: building, medians, ploidy, dosage scores, GC correction.

Everything stays in the long layout (chrom, start, stop, sample, cov); coverage is an
integer, so exact medians per sample keep one entry per distinct count, not per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf

SEX = ["X", "Y", "chrX", "chrY"]


def bin_alignments(aln: DataFrame, width: int = 100, mode: str = "nucleotide", mask: DataFrame | None = None, max_masked: float = 0.05) -> DataFrame:
    """Fragments overlapping each bin. Duplicates, secondary and unmapped records are dropped;
    'nucleotide' counts read spans, 'physical' the span of proper pairs (once per pair).

    Identical spans are counted first, so a pile of copies is one row before it is exploded.
    """
    d = aln.where(~F.col("duplicate") & ~F.col("secondary") & F.col("mapped"))
    if mode == "physical":
        d = d.where(F.col("proper") & (F.col("mate_stop") > F.col("start"))).select("chrom", "sample", "start", F.col("mate_stop").alias("stop"))
    else:
        d = d.select("chrom", "sample", "start", "stop")
    d = d.groupBy("chrom", "sample", "start", "stop").agg(F.count("*").alias("n"))
    b = F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor((F.col("stop") - 1) / width).cast("long"))
    out = d.withColumn("_b", F.explode(b)).groupBy("chrom", "sample", "_b").agg(F.sum("n").alias("cov"))
    out = out.select("chrom", (F.col("_b") * width).alias("start"), ((F.col("_b") + 1) * width).alias("stop"), "sample", "cov")
    if mask is not None:
        from .intervals import coverage_fraction

        bins = out.select("chrom", "start", "stop").distinct()
        ok = coverage_fraction(bins, mask, ["chrom", "start"]).where(F.col("coverage") < max_masked).select("chrom", "start")
        out = out.join(ok, ["chrom", "start"], "left_semi")
    return out


def build_matrix(bincov: DataFrame) -> DataFrame:
    """Keep only full-size bins: the most frequent width of the whole input."""
    w = bincov.groupBy((F.col("stop") - F.col("start")).alias("w")).agg(F.count("*").alias("n")).agg(F.max_by("w", F.struct("n", "w")).alias("_w"))
    return bincov.join(w, F.lit(True)).where(F.col("stop") - F.col("start") == F.col("_w")).drop("_w")


def collapse_bins(bincov: DataFrame, factor: int, width: int) -> DataFrame:
    wide = factor * width
    t = F.floor(F.col("start") / wide).cast("long") * wide
    return bincov.groupBy("chrom", t.alias("start"), "sample").agg(F.sum("cov").alias("cov")).select("chrom", "start", (F.col("start") + wide).alias("stop"), "sample", "cov")


def median_coverage(bincov: DataFrame) -> DataFrame:
    """Per sample: median and MAD over all bins and without bins whose cohort median is 0."""
    bins = bincov.groupBy("chrom", "start").agg(F.percentile("cov", F.lit(0.5)).alias("_bm"))
    d = bincov.join(bins, ["chrom", "start"]).withColumn("_nz", F.when(F.floor("_bm") != 0, F.col("cov")))
    m = d.groupBy("sample").agg(F.percentile("cov", F.lit(0.5)).alias("med_with_zeros"), F.percentile("_nz", F.lit(0.5)).alias("med_without_zeros"))
    x = d.join(m, "sample").groupBy("sample", "med_with_zeros", "med_without_zeros")
    return x.agg(
        (F.percentile(F.abs(F.col("cov") - F.col("med_with_zeros")), F.lit(0.5)) * 1.4826).alias("mad_with_zeros"),
        (F.percentile(F.abs(F.col("_nz") - F.col("med_without_zeros")), F.lit(0.5)) * 1.4826).alias("mad_without_zeros"),
    )


def bin_medians(bincov: DataFrame) -> DataFrame:
    return bincov.groupBy("chrom", "start", "stop").agg(F.percentile("cov", F.lit(0.5)).alias("med_with_zeros"), F.percentile(F.when(F.col("cov") > 0, F.col("cov")), F.lit(0.5)).alias("med_without_zeros"))


def copy_numbers(bincov: DataFrame, ploidy: int = 2, min_samples: float = 0.05, min_cov: float = 0.05) -> DataFrame:
    """Coverage over the sample's autosomal non-zero median x ploidy; bins that are near zero in too many samples go."""
    auto = ~F.col("chrom").isin(SEX)
    m = bincov.where(auto & (F.col("cov") > 0)).groupBy("sample").agg(F.percentile("cov", F.lit(0.5)).alias("_m"))
    d = bincov.join(m, "sample").withColumn("cn", ploidy * F.col("cov") / F.col("_m")).drop("_m")
    low = d.groupBy("chrom", "start").agg((F.count_if(F.col("cn") <= min_cov) / F.count("*")).alias("_z")).where((F.col("_z") <= min_samples) | F.col("chrom").isin(SEX))
    return d.join(low.select("chrom", "start"), ["chrom", "start"], "left_semi")


def contig_copy_numbers(cn: DataFrame) -> DataFrame:
    return cn.groupBy("sample", "chrom").agg(F.percentile("cn", F.lit(0.5)).alias("cn"))


def normalise_contigs(contig_cn: DataFrame, ploidy: DataFrame) -> DataFrame:
    """Shift every contig so that its cohort median is the expected ploidy; floor at 0."""
    m = contig_cn.groupBy("chrom").agg(F.percentile("cn", F.lit(0.5)).alias("_m")).join(ploidy, "chrom")
    return contig_cn.join(m, "chrom").select("sample", "chrom", F.greatest(F.lit(0.0), F.col("cn") - (F.col("_m") - F.col("ploidy"))).alias("cn"))


def dosage_scores(cn: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over model bins of |w| (cn - 2) for w > 0 and |w| (2 - cn) for w < 0."""
    d = cn.join(weights.select("chrom", "start", "weight"), ["chrom", "start"])
    s = F.abs("weight") * F.when(F.col("weight") > 0, F.col("cn") - 2).when(F.col("weight") < 0, 2 - F.col("cn"))
    return d.groupBy("sample").agg((F.sum(s) / F.count("*")).alias("score"))


def assign_sex(contig_cn: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sex from rounded X and Y copy numbers by lookup, with the chance of mosaicism per contig."""
    d = contig_cn.groupBy("sample").agg(F.max(F.when(F.col("chrom").isin("X", "chrX"), F.col("cn"))).alias("x"), F.max(F.when(F.col("chrom").isin("Y", "chrY"), F.col("cn"))).alias("y"))
    d = d.withColumn("cn_x", F.bround("x", 0).cast("int")).withColumn("cn_y", F.bround("y", 0).cast("int")).join(lookup, ["cn_x", "cn_y"], "left")
    d = d.withColumn("sex", F.when(F.col("x").isNull() | F.col("y").isNull(), None).otherwise(F.coalesce("sex", F.lit("OTHER"))))
    sd = d.where("sex = 'MALE'").agg(F.stddev_samp("x").alias("_sx"), F.stddev_samp("y").alias("_sy"))
    d = d.join(sd, F.lit(True))
    pm = lambda v, k, s: norm_cdf(-F.abs(F.col(v) - F.col(k)) / s)
    return d.select("sample", "cn_x", "cn_y", "sex", pm("x", "cn_x", F.when(F.col("cn_x") > 0, F.col("_sx") * F.col("cn_x"))).alias("p_mosaic_x"), pm("y", "cn_y", F.col("_sy") * F.greatest("cn_y", F.lit(1))).alias("p_mosaic_y"))


def abnormal_contigs(contig_cn: DataFrame) -> DataFrame:
    """Smaller normal tail of the contig-scaled copy number and its Benjamini-Hochberg q per contig."""
    s = contig_cn.groupBy("chrom").agg(F.avg("cn").alias("_mu"), F.stddev_samp("cn").alias("_sd"))
    d = contig_cn.join(s, "chrom").withColumn("p", norm_cdf(-F.abs((F.col("cn") - F.col("_mu")) / F.col("_sd"))))
    return benjamini_hochberg(d.drop("_mu", "_sd"), "p", ["chrom"], "sample")


def benjamini_hochberg(d: DataFrame, p: str, by: list[str], tie: str, q: str = "q") -> DataFrame:
    """p n / rank, made monotone from the largest p down. Groups are cohorts (one row per sample)."""
    w = Window.partitionBy(*by)
    d = d.withColumn("_r", F.row_number().over(w.orderBy(p, tie))).withColumn("_n", F.count(p).over(w))
    d = d.withColumn("_v", F.col(p) * F.col("_n") / F.col("_r"))
    return d.withColumn(q, F.least(F.lit(1.0), F.min("_v").over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_r", "_n", "_v")


def gc_correct(bins: DataFrame) -> DataFrame:
    """Shift each sample's coverage per integer GC percent to a common trimmed mean and scale its spread.

    Trims are the 2.5 and 97.5 percentiles of non-zero coverage and of GC; the centre of a GC
    class is the mean within 1.5 IQR of its median; zero bins stay zero.
    """
    d = bins.withColumn("_g", F.bround(F.col("gc") * 100, 0).cast("int"))
    lim = F.array(F.lit(0.025), F.lit(0.975))
    t = d.groupBy("sample").agg(F.percentile(F.when(F.col("cov") > 0, F.col("cov")), lim).alias("_ct"), F.percentile("_g", lim).alias("_gt"))
    d = d.join(t, "sample")
    inside = F.col("cov").between(F.col("_ct")[0], F.col("_ct")[1])
    gin = F.col("_g").between(F.col("_gt")[0], F.col("_gt")[1])
    st = d.groupBy("sample", "_g").agg(
        F.stddev_samp(F.when(inside, F.col("cov"))).alias("_sd"), F.count_if(inside).alias("_nb"), F.bool_or(gin).alias("_gin"),
        F.percentile(F.when(F.col("cov") > 0, F.col("cov")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
    )
    sc = st.groupBy("sample").agg((F.sum(F.when(F.col("_gin"), F.col("_sd") * F.col("_nb"))) / F.sum(F.when(F.col("_gin") & F.col("_sd").isNotNull(), F.col("_nb")))).alias("_ssd"))
    mean = d.where(inside & gin).groupBy("sample").agg(F.avg("cov").alias("_smean"))
    d = d.join(st.select("sample", "_g", "_sd", "_q"), ["sample", "_g"])
    iqr = F.col("_q")[2] - F.col("_q")[0]
    near = F.col("cov").between(F.col("_q")[1] - 1.5 * iqr, F.col("_q")[1] + 1.5 * iqr)
    centre = d.where(near).groupBy("sample", "_g").agg(F.avg("cov").alias("_bm"))
    d = d.join(centre, ["sample", "_g"], "left").join(sc, "sample").join(mean, "sample")
    v = F.col("cov") - F.coalesce("_bm", F.lit(0.0))
    v = v * F.when(F.col("_sd") > 0, F.col("_ssd") / F.col("_sd")).otherwise(1.0) + F.col("_smean")
    return d.select("chrom", "start", "stop", "sample", "cov", F.when(F.col("cov") == 0, 0.0).otherwise(v).alias("corrected"))


def rolling_mean(bins: DataFrame, value: str = "cov", weights=(0.1, 0.2, 1.0, 0.2, 0.1), by=("sample", "chrom"), tile: int = 1 << 20, width: int = 1000) -> DataFrame:
    """Null-aware weighted mean over neighbouring rows in position order.

    Rows are windowed per tile; each tile also receives the few rows next to its borders, so
    no window spans a contig.
    """
    by, k = list(by), len(weights) // 2
    d = bins.withColumn("_t", F.floor(F.col("start") / tile).cast("long"))
    # neighbours across a border: rows within reach of the tile edge, copied to the other tile
    w0 = Window.partitionBy(*by, "_t")
    d = d.withColumn("_i", F.row_number().over(w0.orderBy("start"))).withColumn("_j", F.row_number().over(w0.orderBy(F.desc("start"))))
    own = d.withColumn("_own", F.lit(True))
    nxt = d.where(F.col("_j") <= k).withColumn("_t", F.col("_t") + 1).withColumn("_own", F.lit(False))
    prv = d.where(F.col("_i") <= k).withColumn("_t", F.col("_t") - 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*by, "_t").orderBy("start")
    u = own.unionByName(nxt).unionByName(prv)
    num, den = F.lit(0.0), F.lit(0.0)
    for i, wt in enumerate(weights):
        x = F.lag(value, k - i).over(w) if i <= k else F.lead(value, i - k).over(w)
        num, den = num + F.coalesce(x * wt, F.lit(0.0)), den + F.when(x.isNotNull(), wt).otherwise(0.0)
    u = u.withColumn("smoothed", F.when(den > 0, num / den))
    return u.where("_own").drop("_t", "_i", "_j", "_own")


def train_dosage_bins(cn: DataFrame, groups: DataFrame, min_separation: float = 0.1) -> DataFrame:
    """Welch t statistic and df for bins whose group means differ enough and lie on both sides of 2."""
    d = cn.join(groups, "sample").groupBy("chrom", "start").agg(*[
        f(F.when(F.col("grp") == g, F.col("cn"))).alias(f"{n}_{g.lower()}") for g in ("A", "B") for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    a, b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    ok = (F.abs(F.col("mean_a") - F.col("mean_b")) >= min_separation) & (((F.col("mean_a") >= 2) & (F.col("mean_b") <= 2)) | ((F.col("mean_a") <= 2) & (F.col("mean_b") >= 2)))
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(a + b)
    df = F.pow(a + b, 2) / (a * a / (F.col("n_a") - 1) + b * b / (F.col("n_b") - 1))
    return d.select("chrom", "start", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("separation"), F.when(ok, t).alias("t"), F.when(ok, df).alias("df"))


def matrix_qc(bincov: DataFrame) -> DataFrame:
    """Quantiles of coverage per contig and sample."""
    return bincov.groupBy("chrom", "sample").agg(*[F.percentile("cov", F.lit(q)).alias(n) for n, q in (("q0", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1.0))])


def tail_rows(rows: DataFrame, span: int) -> DataFrame:
    """Evidence rows in the last ``span`` bases of each contig, per sample."""
    end = rows.groupBy("chrom").agg(F.max("pos").alias("_end"))
    return rows.join(end, "chrom").where(F.col("pos") > F.col("_end") - span).groupBy("chrom", "sample").agg(F.count("*").alias("n_rows"))


def segments_to_calls(segments: DataFrame, ploidy: DataFrame, min_quality: float) -> DataFrame:
    """Copy-number segments away from the contig's ploidy, as DEL or DUP calls."""
    d = segments.join(ploidy, ["sample", "chrom"]).where((F.col("cn") != F.col("ploidy")) & (F.col("qs") >= min_quality))
    return d.withColumn("svtype", F.when(F.col("cn") < F.col("ploidy"), "DEL").otherwise("DUP")).drop("ploidy")


def merge_caller_calls(calls: DataFrame, max_gap: int = 0) -> DataFrame:
    """Union of all callers' intervals per (sample, type), numbered per (type, contig) over the cohort."""
    from .intervals import merge_intervals
    from .numbering import number_rows

    m = merge_intervals(calls, by=["sample", "svtype", "chrom"], max_gap=max_gap, aggs=[F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers")])
    return number_rows(m, ["svtype", "chrom"], ["start", "stop", "sample"], "n")
