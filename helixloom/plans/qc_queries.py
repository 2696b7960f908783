"""Callset comparison, QC tables and range checks."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import compare as cp
from ..operators import frequency as fq
from ..operators import qc
from .registry import query

_A = "a AS (SELECT * FROM fx_calls WHERE start % 2 = 0), b AS (SELECT * FROM fx_calls WHERE start % 2 = 1)"


@query("locus_concordance", "WITH a AS (SELECT chrom, start - start % 200 AS pos FROM fx_calls WHERE svtype = 'DEL'), b AS (SELECT chrom, start - start % 200 AS pos FROM fx_calls WHERE svtype = 'DUP'), h AS (SELECT count(*) AS n FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND a.pos = b.pos)) SELECT (SELECT count(*) FROM a) AS n_truth, (SELECT count(*) FROM b) AS n_test, n AS n_shared, round(n / (SELECT count(*) FROM a), 6) AS recall, round(n / (SELECT count(*) FROM b), 6) AS precision FROM h")
def _(t):
    c = t.calls.withColumn("pos", F.col("start") - F.col("start") % 200)
    return cp.locus_concordance(c.where("svtype = 'DEL'"), c.where("svtype = 'DUP'")).withColumns({x: r6(x) for x in ("recall", "precision")})


_MT = "least(x.stop, y.stop) - greatest(x.start, y.start) >= 0.5 * greatest(x.stop - x.start, y.stop - y.start) AND x.start < y.stop AND y.start < x.stop"


@query(
    "callset_match_counts",
    f"""WITH {_A}, ma AS (SELECT x.svtype, EXISTS (SELECT 1 FROM b y WHERE x.chrom = y.chrom AND x.svtype = y.svtype AND {_MT}) AS m FROM a x), mb AS (SELECT x.svtype, EXISTS (SELECT 1 FROM a y WHERE x.chrom = y.chrom AND x.svtype = y.svtype AND {_MT}) AS m FROM b x)
      SELECT p.svtype, tp, fp, fn FROM (SELECT svtype, count(*) FILTER (m) AS tp, count(*) FILTER (NOT m) AS fp FROM ma GROUP BY svtype) p JOIN (SELECT svtype, count(*) FILTER (NOT m) AS fn FROM mb GROUP BY svtype) n ON n.svtype = p.svtype""",
)
def _(t):
    return cp.evaluate(t.calls.where("start % 2 = 0"), t.calls.where("start % 2 = 1"))


_Q = "SELECT vid AS name, chrom, pos AS start, CASE WHEN svtype IN ('INS', 'BND') THEN pos + 1 ELSE stop + 1 END AS stop, svtype FROM fx_sites"
_R = "SELECT chrom, start, stop, svtype, CASE WHEN start % 10 = 0 THEN NULL ELSE CAST(start % 1000 AS DOUBLE) / 1000 END AS af FROM fx_calls WHERE sample IN ('S1', 'S2', 'S3', 'S4') UNION ALL SELECT chrom, start + 40, start + 41, 'INS', CAST(start % 1000 AS DOUBLE) / 1000 FROM fx_calls WHERE sample = 'S5'"
_I = "('INS', 'MEI', 'ALU', 'LINE1', 'SVA')"
_CMP = f"""q AS ({_Q}), r AS ({_R}), p AS (SELECT q.name, q.svtype AS t1, r.svtype AS t2, q.start AS qs, q.stop AS qe, r.start AS rs, r.stop AS re, coalesce(af, 1.0) AS af FROM q JOIN r ON q.chrom = r.chrom AND q.start < r.stop + 250 AND greatest(r.start - 250, 0) < q.stop),
  f AS (SELECT *, least(qe, re) - greatest(qs, rs) AS ov, qs < re AND rs < qe AS rl, t1 = t2 OR (t1 = 'CNV' AND t2 IN ('DEL', 'DUP')) OR (t2 = 'CNV' AND t1 IN ('DEL', 'DUP')) OR (t1 = 'DUP' AND t2 IN {_I}) OR (t2 = 'DUP' AND t1 IN {_I}) OR (t1 IN {_I} AND t2 IN {_I}) OR (t1 = 'INV' AND t2 = 'CPX') OR (t1 = 'CPX' AND t2 = 'INV') AS sm FROM p),
  g AS (SELECT *, (rl AND CASE WHEN qe - qs >= 5000 THEN ov >= 0.5 * (qe - qs) ELSE ov >= 0.1 * (qe - qs) AND ov >= 0.1 * (re - rs) END) OR (t1 IN {_I} AND t2 IN {_I} AND abs(rs - qs) < 100) AS r1, rl AND abs(qs - rs) <= 250 AND abs(qe - re) <= 250 AS r2 FROM f),
  h AS (SELECT name, max(CASE WHEN r1 AND sm THEN af END) AS rule1a, max(CASE WHEN r1 THEN af END) AS rule1b, max(CASE WHEN r2 AND sm THEN af END) AS rule2a, max(CASE WHEN r2 THEN af END) AS rule2b, max(af) AS rule3 FROM g GROUP BY name),
  cmp AS (SELECT q.name, q.svtype, rule1a, rule1b, rule2a, rule2b, rule3, CASE WHEN rule1a IS NOT NULL THEN '1a' WHEN rule2a IS NOT NULL THEN '2a' WHEN rule1b IS NOT NULL THEN '1b' WHEN rule2b IS NOT NULL THEN '2b' WHEN rule3 IS NOT NULL THEN '3' ELSE 'none' END AS category FROM q LEFT JOIN h ON h.name = q.name)"""


def _compared(t):
    return cp.compare_callsets(t.sql(_Q), t.sql(_R))


@query("compare_callsets", f"WITH {_CMP} SELECT * FROM cmp")
def _(t):
    return _compared(t)


def _bin(c, edges):
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} < {e} THEN 'lt_{e}'" for e in edges) + f" ELSE 'gte_{edges[-1]}' END"


@query("benchmark_breakdown", f"WITH {_CMP} SELECT cmp.svtype, {_bin('svlen', qc.SIZE_BINS)} AS size_bin, count(*) AS n, " + ", ".join(f"count(*) FILTER (category = '{c}') AS cat_{c}" for c in ("1a", "1b", "2a", "2b", "3", "none")) + " FROM cmp JOIN fx_sites s ON s.vid = cmp.name GROUP BY 1, 2")
def _(t):
    return qc.benchmark_breakdown(_compared(t), t.sites)


_S = "SELECT vid AS name, chrom, svtype, pos AS start, CASE WHEN svtype = 'INS' THEN pos + 1 ELSE stop END AS stop, svlen FROM fx_sites"
_E = "SELECT name AS ext, chrom, CASE WHEN start % 7 = 0 THEN 'INS' ELSE svtype END AS svtype, start, CASE WHEN start % 7 = 0 THEN start + 1 ELSE stop END AS stop, stop - start AS svlen, CAST(start % 1000 AS DOUBLE) / 1000 AS af FROM fx_calls"


@query(
    "external_frequency_annotation",
    f"""WITH s AS ({_S}), e AS ({_E}), p AS (SELECT s.name, ext, af, round((least(s.stop, e.stop) - greatest(s.start, e.start)) / greatest(s.stop - s.start, e.stop - e.start), 9) AS ro FROM s JOIN e ON s.chrom = e.chrom AND s.svtype = e.svtype AND s.svtype <> 'INS' AND s.stop > s.start AND s.start < e.stop AND e.start < s.stop
        AND least(s.stop, e.stop) - greatest(s.start, e.start) >= 0.1 * (s.stop - s.start) AND least(s.stop, e.stop) - greatest(s.start, e.start) >= 0.1 * (e.stop - e.start)),
      i AS (SELECT s.name, ext, af, abs(e.start - s.start) AS d, abs(s.svlen - e.svlen) AS z FROM s JOIN e ON s.chrom = e.chrom AND s.svtype = 'INS' AND e.svtype = 'INS' AND abs(e.start - s.start) <= 100),
      b AS (SELECT name, ext, af FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY ro DESC, ext) = 1 UNION ALL SELECT name, ext, af FROM i QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, z, ext) = 1)
      SELECT s.name, ext, af FROM s LEFT JOIN b ON b.name = s.name""",
)
def _(t):
    return cp.external_frequencies(t.sql(_S), t.sql(_E))


@query("cluster_member_lookup", "WITH c AS (SELECT cluster, string_agg(vid, ',' ORDER BY vid) AS members FROM fx_breaks GROUP BY cluster) SELECT vid, svtype, cluster FROM fx_breaks WHERE cluster IN (SELECT cluster FROM c)")
def _(t):
    c = t.breaks.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("vid")), ",").alias("members"))
    return cp.reassess_members(t.breaks.select("vid", "svtype"), c)


_AF = "af AS (SELECT vid, sum(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS ac, CASE WHEN sum(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END) > 0 THEN round(sum(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END), 6) ELSE 0.0 END AS af FROM fx_genotypes GROUP BY vid)"
_OK = "filter IN ('PASS', 'BOTHSIDES_SUPPORT', 'MULTIALLELIC', 'HIGH_SR_BACKGROUND')"


def _metric_sql():
    cols = {"count": "true", "pass_count": _OK, "pass_ac_1": f"{_OK} AND ac = 1"}
    for c, edges, tag in (("svlen", qc.SIZE_BINS, "size"), ("af", qc.AF_BINS, "af"), ("qual", qc.VARGQ_BINS, "vargq")):
        for lab in [f"lt_{e}" for e in edges] + [f"gte_{edges[-1]}"]:
            cols[f"pass_{tag}_{lab}".replace(".", "p")] = f"{_OK} AND ({_bin(c, edges)}) = '{lab}'"
    for e in ("PE", "SR", "RD", "BAF"):
        cols[f"pass_evidence_{e}"] = f"{_OK} AND contains(evidence, '{e}')"
    return " UNION ALL ".join(f"SELECT concat('vcf_', svtype, '_{k}') AS metric, CAST(count(*) FILTER ({v}) AS DOUBLE) AS value FROM d GROUP BY svtype" for k, v in cols.items())


@query("callset_metrics", f"WITH {_AF}, d AS (SELECT s.*, af, ac FROM fx_sites s LEFT JOIN af USING (vid)) {_metric_sql()}")
def _(t):
    return qc.callset_metrics(t.sites, fq.allele_frequencies(t.genotypes))


@query(
    "record_error_checks",
    """WITH g AS (SELECT count(*) FILTER (chrom NOT IN ('chr1','chr2','chr3','chr4','chrX') OR chr2 NOT IN ('chr1','chr2','chr3','chr4','chrX')) AS a, count(*) FILTER (stop < pos AND svtype <> 'BND') AS b, count(*) FILTER (svlen < 0 AND svtype NOT IN ('BND','INS','CTX')) AS c, count(*) FILTER (vid IS NULL) AS d, count(*) FILTER (strands NOT IN ('++','+-','-+','--')) AS e, count(*) FILTER (svtype IN ('DEL','DUP') AND chrom <> chr2) AS f FROM fx_sites)
      SELECT 'error_unknown_contig' AS metric, CAST(a AS DOUBLE) AS value FROM g UNION ALL SELECT 'error_end_before_pos', b FROM g UNION ALL SELECT 'error_bad_svlen', c FROM g UNION ALL SELECT 'error_missing_id', d FROM g UNION ALL SELECT 'error_bad_strands', e FROM g UNION ALL SELECT 'error_interchrom_cnv', f FROM g""",
)
def _(t):
    return qc.record_errors(t.sites, ["chr1", "chr2", "chr3", "chr4", "chrX"])


_MET = "SELECT concat('m', CAST(p_partkey AS STRING)) AS metric, CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS DOUBLE) AS value FROM part WHERE p_partkey % 5 <> 0"
_CRI = "SELECT concat('m', CAST(p_partkey AS STRING)) AS metric, CAST(10 AS DOUBLE) AS min, CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 40 END AS DOUBLE) AS max FROM part WHERE p_partkey % 3 <> 0"


@query("range_evaluation", f"WITH m AS ({_MET}), c AS ({_CRI}) SELECT coalesce(m.metric, c.metric) AS metric, c.min, c.max, value, CASE WHEN value IS NULL OR c.min IS NULL OR c.max IS NULL THEN 'NA' WHEN value >= c.min AND value <= c.max THEN 'PASS' ELSE 'FAIL' END AS result FROM m FULL JOIN c ON c.metric = m.metric")
def _(t):
    return qc.evaluate_ranges(t.sql(_MET), t.sql(_CRI))


@query(
    "derive_criteria",
    """WITH m AS (SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS metric, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice / 7 END AS value, p_partkey % 2 = 0 AS i FROM part)
      SELECT metric, round(CASE WHEN i AND value < 10 THEN 0.0 WHEN i THEN round_even(value * 0.9, 0) ELSE value * 0.9 END, 6) AS min, round(CASE WHEN i AND value < 10 THEN 11.0 WHEN i THEN round_even(value * 1.1, 0) ELSE value * 1.1 END, 6) AS max FROM m""",
)
def _(t):
    i = F.col("p_partkey") % 2 == 0
    m = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("metric"), F.when(i, F.col("p_size").cast("double")).otherwise(F.col("p_retailprice") / 7).alias("value"), i.alias("is_integer"))
    return qc.derive_criteria(m).withColumns({c: r6(c) for c in ("min", "max")})


_GC = """gc AS (SELECT vid, count(*) FILTER (a1 = 0 AND a2 = 0) AS n_homref, count(*) FILTER (least(a1, a2) = 0 AND greatest(a1, a2) = 1 AND a1 IS NOT NULL AND a2 IS NOT NULL) AS n_het, count(*) FILTER (a1 = 1 AND a2 = 1) AS n_homalt,
   count(*) FILTER (NOT (a1 IS NULL AND a2 IS NULL) AND NOT (a1 IS NOT NULL AND a2 IS NOT NULL AND greatest(a1, a2) <= 1)) AS n_other, count(*) FILTER (a1 IS NULL AND a2 IS NULL) AS n_unknown FROM fx_genotypes GROUP BY vid)"""


@query("genotype_class_counts", f"WITH {_GC} SELECT *, n_het + 2 * n_homalt AS ac, 2 * (n_homref + n_het + n_homalt) AS an, CASE WHEN n_other = 0 AND n_homref + n_het + n_homalt > 0 THEN round((n_het + 2 * n_homalt) / (2 * (n_homref + n_het + n_homalt)), 6) END AS af FROM gc")
def _(t):
    return qc.genotype_counts(t.genotypes).withColumn("af", r6("af"))


@query(
    "hardy_weinberg",
    f"""WITH {_GC}, x AS (SELECT vid, n_homref AS a, n_het AS b, n_homalt AS c, n_homref + n_het + n_homalt AS n, (n_het + 2 * n_homalt) / (2 * (n_homref + n_het + n_homalt)) AS p FROM gc WHERE n_homref + n_het + n_homalt > 0), e AS (SELECT *, n * (1 - p) * (1 - p) AS e0, 2 * n * p * (1 - p) AS e1, n * p * p AS e2 FROM x)
      SELECT vid, round(a / n, 6) AS f_homref, round(b / n, 6) AS f_het, round(c / n, 6) AS f_homalt, round(CASE WHEN e0 > 0 THEN (a - e0) * (a - e0) / e0 ELSE 0 END + CASE WHEN e1 > 0 THEN (b - e1) * (b - e1) / e1 ELSE 0 END + CASE WHEN e2 > 0 THEN (c - e2) * (c - e2) / e2 ELSE 0 END, 5) AS hwe_chisq FROM e""",
)
def _(t):
    d = qc.hardy_weinberg(qc.genotype_counts(t.genotypes))
    return d.select("vid", *[r6(c).alias(c) for c in ("f_homref", "f_het", "f_homalt")], F.round("hwe_chisq", 5).alias("hwe_chisq"))


@query("site_distributions", f"WITH {_AF} SELECT svtype, {_bin('svlen', qc.SIZE_BINS)} AS size_bin, {_bin('af', qc.AF_BINS)} AS af_bin, count(*) AS n FROM fx_sites LEFT JOIN af USING (vid) GROUP BY 1, 2, 3")
def _(t):
    return qc.site_distributions(t.sites, fq.allele_frequencies(t.genotypes))


@query("sample_quality_distributions", "SELECT sample, svtype, count(*) AS n, round(avg(gq), 6) AS mean, quantile_cont(gq, 0.25) AS q25, median(gq) AS q50, quantile_cont(gq, 0.75) AS q75 FROM fx_genotypes JOIN fx_sites USING (vid) WHERE a1 + a2 > 0 GROUP BY sample, svtype")
def _(t):
    d = t.genotypes.where("a1 + a2 > 0").join(t.sites.select("vid", "svtype"), "vid")
    return qc.quantile_table(d, "gq", ["sample", "svtype"]).withColumn("mean", r6("mean"))


@query("evidence_file_metrics", "SELECT sample, count(*) FILTER (clip = 'left') AS n_left, count(*) FILTER (clip = 'right') AS n_right, CAST(sum(cnt) AS BIGINT) AS total FROM fx_sr GROUP BY sample")
def _(t):
    return t.sr.groupBy("sample").agg(F.count_if(F.col("clip") == "left").alias("n_left"), F.count_if(F.col("clip") == "right").alias("n_right"), F.sum("cnt").alias("total"))


@query("pair_file_metrics", "SELECT sample, concat(strand_a, strand_b) AS orientation, chr_a = chr_b AS same_contig, count(*) AS n FROM fx_pe GROUP BY 1, 2, 3")
def _(t):
    return t.pe.groupBy("sample", F.concat("strand_a", "strand_b").alias("orientation"), (F.col("chr_a") == F.col("chr_b")).alias("same_contig")).agg(F.count("*").alias("n"))


@query("balance_file_metrics", "SELECT sample, count(*) AS n, round(avg(CAST(baf AS DOUBLE)), 6) AS mean, quantile_cont(CAST(baf AS DOUBLE), 0.25) AS q25, median(CAST(baf AS DOUBLE)) AS q50, quantile_cont(CAST(baf AS DOUBLE), 0.75) AS q75 FROM fx_baf GROUP BY sample")
def _(t):
    return qc.quantile_table(t.baf.withColumn("baf", F.col("baf").cast("double")), "baf", ["sample"]).withColumn("mean", r6("mean"))


@query("median_coverage_error", "WITH a AS (SELECT sample, median(cov) AS m FROM fx_bincov GROUP BY sample), b AS (SELECT sample, median(cov) AS m FROM fx_bincov WHERE start % 2000 = 0 GROUP BY sample) SELECT round(avg(abs(a.m - b.m)), 6) AS mean_error, max(abs(a.m - b.m)) AS max_error, count(*) AS n FROM a JOIN b USING (sample)")
def _(t):
    med = lambda d: d.groupBy("sample").agg(F.percentile("cov", F.lit(0.5)).alias("m"))
    return qc.baseline_error(med(t.bincov), med(t.bincov.where("start % 2000 = 0")), "sample", "m").withColumn("mean_error", r6("mean_error"))


@query(
    "pedigree_metrics",
    """WITH f AS (SELECT family, count(*) AS k FROM fx_ped GROUP BY family) SELECT 'ped_samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fx_ped UNION ALL SELECT 'ped_male', count(*) FILTER (sex = 1) FROM fx_ped UNION ALL SELECT 'ped_female', count(*) FILTER (sex = 2) FROM fx_ped UNION ALL SELECT 'ped_affected', count(*) FILTER (phenotype = 2) FROM fx_ped
      UNION ALL SELECT 'ped_trios', count(*) FILTER (father IS NOT NULL AND mother IS NOT NULL) FROM fx_ped UNION ALL SELECT 'ped_families', count(*) FROM f UNION ALL SELECT 'ped_max_family_size', max(k) FROM f UNION ALL SELECT 'ped_singletons', count(*) FILTER (k = 1) FROM f""",
)
def _(t):
    return qc.pedigree_metrics(t.ped)


@query(
    "metrics_file_summary",
    " UNION ALL ".join(f"SELECT 'metrics_{c}_{n}' AS metric, CAST(round({f}, 6) AS DOUBLE) AS value FROM fx_metrics" for c in ("svsize", "baf_ks_log_pval") for n, f in (("mean", f"avg(CAST({c} AS DOUBLE))"), ("min", f"min({c})"), ("max", f"max({c})"), ("null", f"count(*) FILTER ({c} IS NULL)"))),
)
def _(t):
    m = t.metrics.select(F.col("svsize").cast("double").alias("svsize"), F.col("baf_ks_log_pval").cast("double").alias("baf_ks_log_pval"))
    return qc.column_metrics(m, ["svsize", "baf_ks_log_pval"], "metrics").withColumn("value", r6("value"))


@query(
    "record_statistics",
    """WITH g AS (SELECT vid, count(*) FILTER (a1 + a2 > 0) AS n_carriers, count(*) FILTER (a1 + a2 > 0 AND p.father IS NOT NULL) AS n_child_carriers, count(DISTINCT CASE WHEN a1 + a2 > 0 THEN family END) AS n_families, round(avg(CASE WHEN a1 + a2 > 0 THEN gq END), 6) AS mean_carrier_gq FROM fx_genotypes g JOIN fx_ped p USING (sample) GROUP BY vid)
      SELECT s.vid, svtype, svlen, filter, n_carriers, n_child_carriers, n_families, mean_carrier_gq FROM fx_sites s JOIN g USING (vid)""",
)
def _(t):
    g = t.genotypes.join(t.ped, "sample").withColumn("_c", F.col("a1") + F.col("a2") > 0)
    a = g.groupBy("vid").agg(F.count_if("_c").alias("n_carriers"), F.count_if(F.col("_c") & F.col("father").isNotNull()).alias("n_child_carriers"), F.count_distinct(F.when(F.col("_c"), F.col("family"))).alias("n_families"), r6(F.avg(F.when(F.col("_c"), F.col("gq")))).alias("mean_carrier_gq"))
    return t.sites.select("vid", "svtype", "svlen", "filter").join(a, "vid")
