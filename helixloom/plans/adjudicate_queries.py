"""Metric aggregation, labels, cutoffs, scores and genotype training."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..functions.stats import norm_cdf_sql
from ..operators import adjudicate as ad
from ..operators import adjudication as an
from .registry import query

_PROBS = """SELECT name, svtype, svsize, algorithms = 'depth' AS is_depth, CAST(rd_median_separation AS DOUBLE) AS rd_median_separation, CAST(pe_log_pval AS DOUBLE) AS pe_log_pval, CAST(sr_log_pval AS DOUBLE) AS sr_log_pval, CAST(rd_log_pval AS DOUBLE) AS rd_log_pval,
   CAST((svsize * 7 + 3) % 100 AS DOUBLE) / 100 AS baf1_prob, CAST((svsize * 11 + 5) % 100 AS DOUBLE) / 100 AS sr1_prob, CAST((svsize * 13 + 7) % 100 AS DOUBLE) / 100 AS rd_prob, CAST((svsize * 17 + 11) % 100 AS DOUBLE) / 100 AS pe_prob FROM fx_metrics"""


@query(
    "log_pvalue_columns",
    """WITH x AS (SELECT name, CAST((svsize * 7) % 50 AS DOUBLE) / 1000 AS p FROM fx_metrics), m AS (SELECT max(CASE WHEN p > 0 THEN abs(-log10(p)) END) AS mx FROM x)
      SELECT name, round(CASE WHEN p = 0 THEN mx + 5 ELSE abs(-log10(p)) END, 6) AS log_pval FROM x, m""",
)
def _(t):
    x = t.sql("SELECT name, CAST((svsize * 7) % 50 AS DOUBLE) / 1000 AS p FROM fx_metrics")
    return ad.log_pvalues(x, {"log_pval": "p"}).select("name", r6("log_pval").alias("log_pval"))


_SRT = """SELECT vid, coord, CASE coord WHEN 'posA' THEN pos WHEN 'posB' THEN stop ELSE CAST(0 AS BIGINT) END AS pos, CAST(qual % 40 + m AS DOUBLE) AS log_pval, CAST((qual + m) % 30 AS DOUBLE) AS called, CAST((qual * 3 + m) % 25 AS DOUBLE) AS background, CAST(qual % 9 AS DOUBLE) / 9 AS bg_frac
   FROM fx_sites, (SELECT 0 AS m, 'posA' AS coord UNION ALL SELECT 1, 'posB' UNION ALL SELECT 2, 'sum') k"""


@query(
    "pivot_split_read_test",
    f"""WITH s AS ({_SRT}), o AS (SELECT vid, coord, pos, CASE WHEN background > called THEN 0.0 ELSE abs(log_pval) END AS log_pval, called, background, bg_frac FROM s)
      SELECT vid, """ + ", ".join(f"max(CASE WHEN coord = '{c}' THEN {m} END) AS {c.lower()}_{m}" for c in ("posA", "posB", "sum") for m in ("log_pval", "called", "background"))
    + """, max(CASE WHEN coord = 'posA' THEN pos END) AS posa_pos, max(CASE WHEN coord = 'posB' THEN pos END) AS posb_pos FROM o GROUP BY vid""",
)
def _(t):
    d = ad.pivot_split_test(t.sql(_SRT))
    return d.drop("posa_bg_frac", "posb_bg_frac", "sum_bg_frac")


@query(
    "variant_metadata",
    """WITH s AS (SELECT vid, svtype, chrom, svlen AS svsize FROM fx_sites WHERE svtype IN ('DEL', 'DUP', 'INV', 'BND', 'INS')), c AS (SELECT c.*, svtype FROM fx_carriers c JOIN s USING (vid)),
      n AS (SELECT svtype, sample, count(*) AS n FROM c GROUP BY svtype, sample), q AS (SELECT svtype, quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS t FROM n GROUP BY svtype),
      o AS (SELECT n.svtype, sample, n >= t AS o FROM n JOIN q ON q.svtype = n.svtype), v AS (SELECT vid, count(*) AS n, bool_and(o) AS a FROM c JOIN o ON o.svtype = c.svtype AND o.sample = c.sample GROUP BY vid)
      SELECT s.vid, chrom, s.svtype, svsize, round(coalesce(n, 0) / 40, 6) AS vf, CASE WHEN t IS NULL THEN false ELSE coalesce(a, true) END AS is_outlier_specific FROM s LEFT JOIN v USING (vid) LEFT JOIN q ON q.svtype = s.svtype""",
)
def _(t):
    return ad.variant_metadata(t.sites, t.carriers, t.samples.count()).withColumn("vf", r6("vf"))


@query(
    "metric_outer_join",
    """WITH a AS (SELECT vid, avg(pe_gq) AS pe FROM fx_genotypes WHERE pe_gt > 0 GROUP BY vid), b AS (SELECT vid, avg(sr_gq) AS sr FROM fx_genotypes WHERE sr_gt > 1 GROUP BY vid), c AS (SELECT vid, CASE WHEN max(rd_gq) > 990 THEN CAST('inf' AS DOUBLE) ELSE avg(rd_gq) END AS rd FROM fx_genotypes WHERE rd_cn <> 2 GROUP BY vid)
      SELECT coalesce(a.vid, b.vid, c.vid) AS vid, round(pe, 6) AS pe, round(sr, 6) AS sr, round(CASE WHEN isinf(rd) THEN 300 ELSE rd END, 6) AS rd FROM a FULL JOIN b ON a.vid = b.vid FULL JOIN c ON c.vid = coalesce(a.vid, b.vid)""",
)
def _(t):
    g = t.genotypes
    a = g.where("pe_gt > 0").groupBy("vid").agg(F.avg("pe_gq").alias("pe"))
    b = g.where("sr_gt > 1").groupBy("vid").agg(F.avg("sr_gq").alias("sr"))
    c = g.where("rd_cn <> 2").groupBy("vid").agg(F.when(F.max("rd_gq") > 990, F.lit(float("inf"))).otherwise(F.avg("rd_gq")).alias("rd"))
    return ad.join_metrics(a, b, c).withColumns({x: r6(x) for x in ("pe", "sr", "rd")})


def _lab(fail, ok):
    return f"CASE WHEN {fail} THEN 'Fail' WHEN {ok} THEN 'Pass' ELSE 'Unlabeled' END"


@query(
    "training_labels",
    f"""WITH p AS ({_PROBS}) SELECT name, {_lab('rd_median_separation >= 0 AND rd_median_separation < 0.15', 'rd_median_separation >= 0.4 AND rd_median_separation < 1.0')} AS baf1,
      {_lab('rd_median_separation < 0.15 AND baf1_prob < 0.4 AND pe_log_pval < 1.3010299956639813', 'rd_median_separation >= 0.4 AND baf1_prob >= 0.9')} AS sr1,
      CASE WHEN svsize >= 1000 THEN {_lab('baf1_prob < 0.4 AND sr1_prob < 0.4', 'baf1_prob >= 0.9 AND sr1_prob >= 0.9')} ELSE {_lab('sr1_prob < 0.4', 'sr1_prob >= 0.9')} END AS rd,
      {_lab('sr1_prob < 0.4 AND rd_prob < 0.4 AND svsize >= 1000', 'sr1_prob >= 0.9 AND rd_prob >= 0.9 AND svsize >= 1000')} AS pe,
      {_lab('rd_prob < 0.4 AND pe_prob < 0.4 AND sr1_prob < 0.4 AND baf1_prob < 0.4', 'rd_prob >= 0.9 AND pe_prob >= 0.9 AND sr1_prob >= 0.9 AND baf1_prob >= 0.4')} AS baf2,
      {_lab('rd_prob < 0.4 OR pe_prob < 0.4', 'rd_prob >= 0.9 AND pe_prob >= 0.9 AND sr1_prob >= 0.4')} AS sr2,
      {_lab('rd_prob < 0.4 AND pe_prob < 0.4 AND sr1_prob < 0.4', 'rd_prob >= 0.9 AND pe_prob >= 0.9 AND sr1_prob >= 0.9')} AS pesr FROM p""",
)
def _(t):
    return t.sql(_PROBS).select("name", *[ad.training_label(k).alias(k.lower()) for k in ("BAF1", "SR1", "RD", "PE", "BAF2", "SR2", "PESR")])


_ROC = """r0 AS (SELECT svtype, {m} AS th, count(*) FILTER (rd_prob >= 0.5) AS p, count(*) FILTER (rd_prob < 0.5) AS n FROM pr GROUP BY svtype, {m}),
  r1 AS (SELECT svtype, th, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY svtype) AS ap, sum(n) OVER (PARTITION BY svtype) AS an, lead(p) OVER w AS np, lead(n) OVER w AS nn, lag(p) OVER w AS lp FROM r0 WINDOW w AS (PARTITION BY svtype ORDER BY th DESC)),
  r AS (SELECT svtype, th, tp / ap AS tpr, fp / an AS fpr FROM r1 WHERE lp IS NULL OR np IS NULL OR np <> p OR nn <> n)"""


@query("roc_cutoff", f"WITH pr AS ({_PROBS}), {_ROC.format(m='rd_log_pval')} SELECT svtype, CASE WHEN min(round(sqrt(fpr * fpr + (tpr - 1) * (tpr - 1)), 12)) >= 1 THEN max(th) ELSE min_by(th, (round(sqrt(fpr * fpr + (tpr - 1) * (tpr - 1)), 12), -th)) END AS cutoff FROM r GROUP BY svtype")
def _(t):
    return ad.roc_cutoff(t.sql(_PROBS), "rd_log_pval", "rd_prob", ["svtype"])


@query("fdr_cutoff", f"WITH pr AS ({_PROBS}), {_ROC.format(m='pe_log_pval')} SELECT svtype, coalesce(max(CASE WHEN fpr > 0.05 THEN th END), min(th)) AS cutoff FROM r GROUP BY svtype")
def _(t):
    return ad.fdr_cutoff(t.sql(_PROBS), "pe_log_pval", "rd_prob", 0.05, ["svtype"])


@query(
    "force_scores_by_cutoffs",
    f"WITH p AS ({_PROBS}) SELECT name, CASE WHEN rd_prob >= 0.5 AND (rd_log_pval < 4 OR rd_median_separation < 0.3) THEN 0.499 WHEN rd_prob < 0.5 AND rd_log_pval >= 4 AND rd_median_separation >= 0.3 THEN 0.501 ELSE rd_prob END AS rd_prob FROM p",
)
def _(t):
    return ad.force_by_cutoffs(t.sql(_PROBS), {"rd_log_pval": 4.0, "rd_median_separation": 0.3}, "rd_prob").select("name", "rd_prob")


@query(
    "consolidate_scores",
    f"""WITH p0 AS ({_PROBS}), p AS (SELECT * REPLACE (CASE WHEN is_depth AND svsize < 5000 AND rd_prob >= 0.5 THEN 0.499 ELSE rd_prob END AS rd_prob) FROM p0),
      q AS (SELECT *, greatest(pe_prob, sr1_prob) AS rp, greatest(pe_prob, sr1_prob) >= 0.5 AS ro, rd_prob >= 0.5 AS dok FROM p)
      SELECT name, CASE WHEN is_depth THEN rd_prob WHEN svsize < 5000 THEN rp WHEN ro = dok THEN greatest(rp, rd_prob) WHEN ro THEN rp
        WHEN svtype = 'DEL' THEN CASE WHEN rd_log_pval >= 5 AND rd_median_separation >= 0.4 THEN rd_prob ELSE 0.495 END WHEN svtype = 'DUP' THEN CASE WHEN rd_log_pval >= 6 THEN rd_prob ELSE 0.495 END END AS score,
        CASE WHEN NOT is_depth AND svsize >= 5000 AND ro AND NOT dok THEN 'BND' ELSE svtype END AS adj_svtype FROM q""",
)
def _(t):
    cuts = {"DEL": {"rd_log_pval": 5.0, "rd_median_separation": 0.4}, "DUP": {"rd_log_pval": 6.0}}
    return ad.consolidate_scores(t.sql(_PROBS), cuts).select("name", "score", "adj_svtype")


@query("random_forest_scores")
def _(t):
    m = t.sql("SELECT name, svtype, svsize, poor_region_cov, CAST(rd_median_separation AS DOUBLE) AS rd_median_separation, CAST(baf_del_loglik AS DOUBLE) AS baf_del_loglik, CAST(baf_ks_log_pval AS DOUBLE) AS baf_ks_log_pval FROM fx_metrics WHERE svtype = 'DEL' AND svsize >= 5000")
    m = m.withColumn("label", ad.training_label("BAF1"))
    d = ad.train_and_score(m, ["baf_del_loglik", "baf_ks_log_pval"], "label", trees=20, depth=5)
    return d.select("name", "label", F.col("prob").between(0, 1).alias("is_probability"))


@query(
    "allele_balance_training_set",
    """SELECT name, svtype, CASE WHEN rd_median_separation >= 0.4 THEN 'Pass' ELSE 'Fail' END AS status FROM fx_metrics WHERE svsize >= 5000 AND poor_region_cov < 0.3 AND (rd_median_separation >= 0.4 OR rd_median_separation < 0.15)
      AND ((svtype = 'DEL' AND baf_del_loglik IS NOT NULL) OR (svtype = 'DUP' AND baf_ks_log_pval IS NOT NULL))""",
)
def _(t):
    return ad.training_set(t.metrics).select("name", "svtype", "status")


@query(
    "merge_allosome_tests",
    """WITH x AS (SELECT vid AS name, chrom, qual AS v FROM fx_sites WHERE chrom IN ('chrX', 'chrY')), m AS (SELECT name, chrom, v FROM x), f AS (SELECT name, chrom, v * 2 AS v FROM x WHERE v % 3 <> 0)
      SELECT m.name, m.chrom, CASE WHEN m.chrom = 'chrY' THEN m.v ELSE coalesce(f.v, m.v) END AS v FROM m LEFT JOIN f ON f.name = m.name""",
)
def _(t):
    x = t.sites.where("chrom IN ('chrX', 'chrY')").select(F.col("vid").alias("name"), "chrom", F.col("qual").alias("v"))
    return ad.merge_allosomes(x, x.where("v % 3 <> 0").withColumn("v", F.col("v") * 2))


_PEG = "SELECT vid, sample, CASE rd_cn WHEN 2 THEN pe_gq % 4 WHEN 1 THEN 8 + pe_gq % 9 WHEN 3 THEN 8 + pe_gq % 11 ELSE 12 + pe_gq % 20 END AS cnt, rd_cn FROM fx_genotypes"
_PAR = """md AS (SELECT median(cnt) AS m FROM g WHERE rd_cn IN (1, 3)), a AS (SELECT max(m) + 1.645 * (median(abs(cnt - m)) * 1.4826) AS het_cutoff, 1.645 * (median(abs(cnt - m)) * 1.4826) AS sd_het FROM g, md WHERE rd_cn IN (1, 3)),
  par AS (SELECT het_cutoff, sd_het, (SELECT median(cnt) FROM g WHERE rd_cn IN (0, 4) AND cnt >= het_cutoff) AS median_hom FROM a)"""


@query("train_read_genotypes", f"WITH g AS ({_PEG}), {_PAR} SELECT round(het_cutoff, 6) AS het_cutoff, round(sd_het, 6) AS sd_het, median_hom FROM par")
def _(t):
    return ad.train_read_genotypes(t.sql(_PEG)).withColumns({c: r6(c) for c in ("het_cutoff", "sd_het")})


def _ph(x):
    return f"(-10 * log10(greatest({norm_cdf_sql(f'(-({x}))')}, 1e-300)))"


@query(
    "call_read_genotypes",
    f"""WITH g AS ({_PEG}), {_PAR}, k AS (SELECT g.*, par.*, CAST(CASE WHEN cnt < 5 THEN 0 WHEN cnt <= median_hom - sd_het THEN 1 ELSE floor(cnt / (median_hom / 2) + 0.5) END AS INT) AS gt FROM g, par),
      n AS (SELECT *, 999 / ({_ph('(median_hom / 2) / sd_het')} - 3.0103) AS nm, {_ph('abs(cnt - (gt - 1) * (median_hom / 2)) / sd_het')} AS z1, {_ph('abs(cnt - (gt + 1) * (median_hom / 2)) / sd_het')} AS z2, {_ph('abs(cnt - gt * (median_hom / 2)) / sd_het')} AS z0 FROM k),
      q AS (SELECT vid, sample, gt, CASE WHEN gt = 0 THEN CASE WHEN cnt = 0 THEN 999.0 ELSE round_even(-10 * log10(1 - exp(-CAST(cnt AS DOUBLE))) * nm, 0) END ELSE round_even((least(z1, z2) - z0) * nm, 0) END AS gq FROM n)
      SELECT vid, sample, gt, CAST(CASE WHEN gq < 0 THEN 1 WHEN gq > 999 THEN 999 ELSE gq END AS INT) AS gq FROM q""",
)
def _(t):
    g = t.sql(_PEG)
    return ad.call_read_genotypes(g, ad.train_read_genotypes(g), 5).select("vid", "sample", "gt", "gq")


@query(
    "read_variant_quality",
    f"""WITH g AS ({_PEG}), {_PAR}, q AS (SELECT vid, median(CASE WHEN cnt >= 5 THEN cnt END) AS m FROM g GROUP BY vid)
      SELECT vid, round(coalesce(CASE WHEN m IS NULL THEN NULL ELSE least(999.0, m * 999 / (median_hom / 2)) END, 0.0), 6) AS quality FROM q, par""",
)
def _(t):
    g = t.sql(_PEG)
    p = ad.train_read_genotypes(g)
    return ad.variant_quality(ad.call_read_genotypes(g, p, 5), p).withColumn("quality", F.round(F.when(F.col("quality").isNotNull(), F.col("quality")), 6))


@query(
    "bothside_support_fraction",
    """WITH g AS (SELECT g.*, batch FROM fx_genotypes g JOIN fx_samples USING (sample)), p AS (SELECT vid, count(DISTINCT batch) AS n_pass FROM g WHERE sr_gt > 1 GROUP BY vid), n AS (SELECT vid, count(DISTINCT batch) AS n FROM g WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0 OR sr_gt > 0 GROUP BY vid)
      SELECT vid, round(least(1.0, n_pass / n), 6) AS support FROM p JOIN n USING (vid)""",
)
def _(t):
    g = t.genotypes.join(t.samples.select("sample", "batch"), "sample")
    return ad.bothside_support(g.where("sr_gt > 1"), g.where("coalesce(a1, 0) + coalesce(a2, 0) > 0 OR sr_gt > 0")).withColumn("support", r6("support"))


@query("non_reference_ids", "SELECT DISTINCT vid FROM fx_genotypes WHERE coalesce(a1, 0) + coalesce(a2, 0) > 0 OR sr_gt > 0")
def _(t):
    return t.genotypes.where("coalesce(a1, 0) + coalesce(a2, 0) > 0 OR sr_gt > 0").select("vid").distinct()


_SIDE = "SELECT sr_gq % 15 AS cnt, rd_cn <> 2 AS truth, gq > 50 AS common FROM fx_genotypes"


@query(
    "split_read_side_cutoffs",
    f"""WITH s AS ({_SIDE}), g AS (SELECT common, c AS cutoff, count(*) FILTER (truth AND cnt >= c) / count(*) FILTER (truth) AS sens, count(*) FILTER (NOT truth AND cnt < c) / count(*) FILTER (NOT truth) AS spec FROM s, (SELECT CAST(unnest(range(0, 15)) AS INT) AS c) k GROUP BY common, c)
      SELECT common, min_by(cutoff, (round(sqrt((1 - sens) * (1 - sens) + (1 - spec) * (1 - spec)), 9), cutoff)) AS cutoff FROM g GROUP BY common""",
)
def _(t):
    return ad.side_cutoffs(t.sql(_SIDE), list(range(15)))


# every seventh variant lacks the depth genotype of some samples; a few qualities stand at either end of the scale
_IGQ = """SELECT g.vid, g.sample, svtype, svlen, algorithms, CASE WHEN qual % 7 = 0 AND gq % 5 = 0 THEN NULL ELSE rd_cn END AS rd_cn, CASE WHEN rd_gq % 10 = 9 THEN 999 ELSE rd_gq END AS rd_gq, pe_gt, CASE WHEN pe_gq % 10 = 3 THEN 999 ELSE pe_gq END AS pe_gq, sr_gt,
    CASE WHEN sr_gq % 11 = 3 THEN 0 ELSE sr_gq END AS sr_gq FROM fx_genotypes g JOIN fx_sites s ON s.vid = g.vid"""
_ONE = "CASE WHEN {c} = 0 THEN 1 ELSE {c} END"


def _ones(*cols):
    return ", ".join(f"{_ONE.format(c=c)} AS {c}" for c in cols)


_CHOICE = """x AS (SELECT *, CASE WHEN pe_gt = sr_gt AND pe_gq >= sr_gq THEN 1 WHEN pe_gt = sr_gt THEN 2 WHEN pe_gt > 0 AND sr_gt = 0 THEN 3 WHEN pe_gt = 0 AND sr_gt > 0 THEN 4 WHEN pe_gq >= sr_gq THEN 1 ELSE 2 END AS w FROM d),
  y AS (SELECT *, CASE WHEN w IN (1, 3) THEN pe_gt ELSE sr_gt END AS g0, CASE WHEN w IN (1, 3) THEN pe_gq ELSE sr_gq END AS q0, CASE w WHEN 3 THEN 'PE' WHEN 4 THEN 'SR' ELSE 'PE,SR' END AS e0 FROM x)"""
_SIZED = "CASE WHEN svtype NOT IN ('DEL', 'DUP') OR {gap} THEN 2 WHEN algorithms = 'depth' THEN 1 WHEN svlen >= 5000 THEN 3 WHEN svlen >= 1000 THEN 4 ELSE 5 END"


def _cp(g):
    return f"CASE WHEN svtype = 'DEL' THEN CASE WHEN {g} > 1 THEN 0 WHEN {g} = 1 THEN 1 ELSE 2 END WHEN {g} > 0 THEN {g} + 2 ELSE 2 END"


@query(
    "integrate_genotype_quality",
    f"""WITH d AS ({_IGQ}), {_CHOICE}, k AS (SELECT *, {_SIZED.format(gap='bool_or(rd_cn IS NULL) OVER (PARTITION BY vid)')} AS cl, {_cp('g0')} AS c, {_cp('pe_gt')} AS p, {_cp('sr_gt')} AS s, rd_cn AS r FROM y),
      a AS (SELECT *, CASE cl WHEN 1 THEN 'RD' WHEN 2 THEN e0
          WHEN 3 THEN CASE WHEN r = p AND r = s THEN 'RD,PE,SR' WHEN r = 2 AND r = p THEN 'RD,PE' WHEN r = 2 AND r = s THEN 'RD,SR' WHEN r = 2 THEN 'RD' WHEN p <> 2 AND s <> 2 THEN 'RD,PE,SR' WHEN p <> 2 THEN 'RD,PE' WHEN s <> 2 THEN 'RD,SR' ELSE 'RD' END
          WHEN 4 THEN CASE WHEN r = p AND r = s THEN 'RD,PE,SR' WHEN c = 2 AND r = 2 AND p = 2 THEN 'RD,PE' WHEN c = 2 AND r = 2 AND s = 2 THEN 'RD,SR' WHEN c = 2 AND p = 2 AND s = 2 THEN 'PE,SR' WHEN c = 2 AND p = 2 THEN 'PE' WHEN c = 2 THEN 'SR'
            WHEN r <> 2 AND p <> 2 AND s <> 2 THEN 'RD,PE,SR' WHEN r <> 2 AND p <> 2 THEN 'RD,PE' WHEN r <> 2 AND s <> 2 THEN 'RD,SR' WHEN p = 2 THEN 'SR' WHEN s = 2 THEN 'PE' ELSE 'PE,SR' END
          ELSE CASE WHEN r = p AND r = s THEN 'RD,PE,SR' WHEN c = 2 AND r = 2 AND p = 2 THEN 'RD,PE' WHEN c = 2 AND r = 2 AND s = 2 THEN 'RD,SR' WHEN c = 2 AND p = 2 AND s = 2 THEN 'PE,SR' WHEN c = 2 AND p = 2 THEN 'PE' WHEN c = 2 THEN 'SR'
            WHEN r <> 2 AND p <> 2 AND s <> 2 THEN 'RD,PE,SR' WHEN r = c AND p <> 2 AND s = 2 THEN 'RD,PE' WHEN r = c AND p = 2 AND s <> 2 THEN 'RD,SR' WHEN p = 2 THEN 'SR' WHEN s = 2 THEN 'PE' ELSE 'PE,SR' END END AS ev,
        CASE WHEN cl IN (1, 3) THEN CASE WHEN svtype = 'DEL' THEN CASE WHEN r >= 2 THEN 0 WHEN r = 1 THEN 1 ELSE 2 END WHEN r <= 2 THEN 0 ELSE r - 2 END ELSE g0 END AS gt,
        CASE cl WHEN 1 THEN rd_gq WHEN 2 THEN q0 WHEN 3 THEN CASE WHEN rd_gq = 999 THEN 999 WHEN r = c THEN rd_gq + (999 - rd_gq) * (q0 / 999) * 0.5 ELSE rd_gq - (rd_gq - 1) * (q0 / 999) * 0.5 END
          WHEN 4 THEN CASE WHEN q0 = 999 THEN 999 WHEN r = c THEN q0 + (999 - q0) * (rd_gq / 999) * 0.5 ELSE q0 - (q0 - 1) * (rd_gq / 999) * 0.5 END
          ELSE CASE WHEN q0 = 999 THEN 999 WHEN p = s AND pe_gq >= sr_gq THEN q0 + (999 - q0) * (sr_gq / 999) * 0.5 WHEN p = s THEN q0 + (999 - q0) * (pe_gq / 999) * 0.5 ELSE q0 END END::DOUBLE AS gq FROM k)
      SELECT vid, sample, rd_cn, {_ones('rd_gq', 'pe_gq', 'sr_gq')}, pe_gt, sr_gt, CAST(least(gt, 2) AS INT) AS gt, round({_ONE.format(c='gq')}, 6) AS gq, ev FROM a""",
)
def _(t):
    return ad.integrate_quality(t.sql(_IGQ)).withColumn("gq", r6("gq"))


@query("integrate_read_genotype_quality", f"WITH d AS ({_IGQ}), {_CHOICE} SELECT vid, sample, pe_gt, sr_gt, {_ones('pe_gq', 'sr_gq')}, CAST(least(g0, 2) AS INT) AS gt, {_ONE.format(c='q0')} AS gq, e0 AS ev FROM y")
def _(t):
    return ad.integrate_read_quality(t.sql(_IGQ))


@query("integrate_depth_genotype_quality", f"WITH d AS ({_IGQ}) SELECT vid, sample, rd_cn, {_ones('rd_gq')}, CAST(CASE WHEN svtype = 'DEL' THEN CASE WHEN rd_cn >= 2 THEN 0 WHEN rd_cn = 1 THEN 1 ELSE 2 END WHEN rd_cn <= 2 THEN 0 WHEN rd_cn - 2 > 4 THEN 2 ELSE rd_cn - 2 END AS INT) AS gt, {_ONE.format(c='rd_gq')} AS gq, 'RD' AS ev FROM d WHERE svtype IN ('DEL', 'DUP') AND rd_cn IS NOT NULL")
def _(t):
    return ad.integrate_depth_quality(t.sql(_IGQ).where("rd_cn IS NOT NULL"))


_VGQ = "SELECT vid, svtype, svlen, algorithms, qual % 7 = 0 AS no_depth, CASE WHEN qual % 5 = 0 THEN 999 ELSE qual % 400 END AS rd_q, (qual * 7) % 1000 AS pe_q, (qual * 13) % 1000 AS sr_q FROM fx_sites"


@query(
    "integrate_variant_quality",
    f"""WITH v AS ({_VGQ}), k AS (SELECT *, {_SIZED.format(gap='no_depth')} AS cl FROM v), a AS (SELECT *, CASE cl WHEN 1 THEN rd_q WHEN 2 THEN CASE WHEN pe_q >= sr_q THEN pe_q ELSE sr_q END
        WHEN 3 THEN CASE WHEN rd_q = 999 THEN 999 WHEN pe_q >= sr_q THEN rd_q + (999 - rd_q) * (pe_q / 999) * 0.5 ELSE rd_q + (999 - rd_q) * (sr_q / 999) * 0.5 END
        ELSE CASE WHEN pe_q = 999 OR sr_q = 999 THEN 999 WHEN pe_q >= sr_q THEN pe_q + (999 - pe_q) * (rd_q / 999) * 0.5 ELSE sr_q + (999 - sr_q) * (rd_q / 999) * 0.5 END END::DOUBLE AS q FROM k)
      SELECT vid, {_ones('rd_q', 'pe_q', 'sr_q')}, round({_ONE.format(c='q')}, 6) AS q FROM a""",
)
def _(t):
    return ad.integrate_variant_quality(t.sql(_VGQ)).withColumn("q", r6("q"))


# ---- adjudication of all strata ----------------------------------------------------------------

_ADJ = """SELECT name, CASE WHEN svsize % 29 = 0 THEN 'chrX' ELSE chrom END AS chrom, svtype, svsize, algorithms = 'depth' AND svtype IN ('DEL', 'DUP') AS is_depth, CAST(poor_region_cov AS DOUBLE) AS poor_region_cov, is_outlier_specific,
    CAST(rd_median_separation AS DOUBLE) AS rd_median_separation, CAST(rd_log_pval AS DOUBLE) + 4 * CAST(rd_median_separation AS DOUBLE) AS rd_log_pval, CAST(rd_log_2nd_max_p AS DOUBLE) + CAST(rd_median_separation AS DOUBLE) AS rd_log_2nd_max_p,
    CAST(baf_del_loglik AS DOUBLE) + 2 * CAST(rd_median_separation AS DOUBLE) AS baf_del_loglik, CAST(rd_median_separation AS DOUBLE) + (svsize % 10) / 40.0 AS baf_snp_ratio, CAST(baf_ks_log_pval AS DOUBLE) + 5 * CAST(rd_median_separation AS DOUBLE) AS baf_ks_log_pval, CAST(rd_median_separation AS DOUBLE) / 2 + (svsize % 7) / 50.0 AS baf_ks_stat,
    CAST(sr_log_pval AS DOUBLE) / 4 + 6 * CAST(rd_median_separation AS DOUBLE) AS sr_log_pval, CAST(rd_median_separation AS DOUBLE) / 3 + (svsize % 11) / 60.0 AS sr_bg_frac, CAST(pe_log_pval AS DOUBLE) / 4 + 6 * CAST(rd_median_separation AS DOUBLE) AS pe_log_pval,
    CAST(rd_median_separation AS DOUBLE) / 3 + (svsize % 13) / 60.0 AS pe_bg_frac, CAST(pe_log_pval AS DOUBLE) / 8 + CAST(sr_log_pval AS DOUBLE) / 8 + 6 * CAST(rd_median_separation AS DOUBLE) AS pesr_log_pval, CAST(rd_median_separation AS DOUBLE) / 3 + (svsize % 17) / 60.0 AS pesr_bg_frac FROM fx_metrics"""


def _stratum_sql(i, s):
    has = " AND ".join(f"{f} IS NOT NULL" for f in s.features)
    return f"SELECT {i} AS stratum, '{s.test}' AS test, '{s.algtype}' AS algtype, '{s.svtype}' AS svtype, count(*) AS n_testable, count(*) FILTER ({s.train} AND poor_region_cov < 0.3 AND chrom NOT IN ('chrX', 'chrY') AND NOT is_outlier_specific) AS n_trainable FROM a WHERE {s.where} AND {has}"


@query("adjudication_strata", f"WITH a AS ({_ADJ}) " + " UNION ALL ".join(_stratum_sql(i, s) for i, s in enumerate(an.STRATA)))
def _(t):
    return an.stratum_sizes(t.sql(_ADJ))


def _adjudicated(t):
    return an.adjudicate(t.sql(_ADJ), trees=20, depth=6)


@query("adjudication_cutoffs")
def _(t):
    return _adjudicated(t)[1]


@query("adjudicated_scores")
def _(t):
    return _adjudicated(t)[0]
