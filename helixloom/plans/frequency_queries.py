"""Frequencies, outliers and families."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import family as fam
from ..operators import frequency as fq
from ..operators import outliers as out
from .registry import query

_CNT = """CAST(sum(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS an,
  CAST(sum(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ac,
  CAST(sum(CASE WHEN a1 = 0 AND a2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_homref,
  CAST(sum(CASE WHEN (a1 = 0 AND a2 > 0) OR (a1 > 0 AND a2 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS n_het,
  CAST(sum(CASE WHEN a1 > 0 AND a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_homalt"""
_FRQ = """CASE WHEN an > 0 THEN round(ac / an, 6) ELSE 0.0 END AS af, n_homref + n_het + n_homalt AS n_bi_genos,
  CASE WHEN n_homref + n_het + n_homalt > 0 THEN round(n_homref / (n_homref + n_het + n_homalt), 6) ELSE 0.0 END AS freq_homref,
  CASE WHEN n_homref + n_het + n_homalt > 0 THEN round(n_het / (n_homref + n_het + n_homalt), 6) ELSE 0.0 END AS freq_het,
  CASE WHEN n_homref + n_het + n_homalt > 0 THEN round(n_homalt / (n_homref + n_het + n_homalt), 6) ELSE 0.0 END AS freq_homalt"""


def _round_freqs(d):
    return d.withColumns({c: r6(c) for c in ("freq_homref", "freq_het", "freq_homalt")})


@query("allele_frequencies", f"SELECT *, {_FRQ} FROM (SELECT vid, {_CNT} FROM fx_genotypes GROUP BY vid) x")
def _(t):
    return _round_freqs(fq.allele_frequencies(t.genotypes))


_STRATA = f"""f AS (SELECT vid, pop, sex, chrom IN ('chrX', 'chrY') AS hemi, {_CNT} FROM fx_genotypes JOIN fx_samples USING (sample) JOIN fx_sites USING (vid) GROUP BY vid, pop, sex, chrom),
  a AS (SELECT vid, pop, sex, CASE WHEN hemi AND sex = 'MALE' THEN an / 2 ELSE CAST(an AS DOUBLE) END AS an, CASE WHEN hemi AND sex = 'MALE' THEN n_het + n_homalt ELSE ac END AS ac, n_homref, n_het, n_homalt FROM f),
  s AS (SELECT vid, CASE WHEN grouping(pop) = 1 THEN 'ALL' ELSE pop END AS pop, CASE WHEN grouping(sex) = 1 THEN 'ALL' ELSE sex END AS sex, sum(an) AS an, CAST(sum(ac) AS BIGINT) AS ac,
    CAST(sum(n_homref) AS BIGINT) AS n_homref, CAST(sum(n_het) AS BIGINT) AS n_het, CAST(sum(n_homalt) AS BIGINT) AS n_homalt FROM a
    GROUP BY GROUPING SETS ((vid), (vid, sex), (vid, pop), (vid, pop, sex)))"""


@query("allele_frequencies_by_population_and_sex", f"WITH {_STRATA} SELECT *, {_FRQ} FROM s")
def _(t):
    return _round_freqs(fq.stratified_frequencies(t.genotypes, t.sites, t.samples))


@query(
    "sex_contig_frequencies_off_par",
    f"""WITH par AS (SELECT 'chrX' AS chrom, start, stop FROM fx_regions UNION ALL SELECT 'chrY', start, stop FROM fx_regions),
      f AS (SELECT vid, sex, chrom IN ('chrX', 'chrY') AND NOT EXISTS (SELECT 1 FROM par WHERE par.chrom = st.chrom AND least(st.pos, st.stop) < par.stop AND par.start < greatest(st.pos, st.stop)) AS hemi, {_CNT}
        FROM fx_genotypes JOIN fx_samples USING (sample) JOIN fx_sites st USING (vid) GROUP BY vid, sex, chrom, st.pos, st.stop)
      SELECT vid, sex, CASE WHEN hemi AND sex = 'MALE' THEN an / 2 ELSE CAST(an AS DOUBLE) END AS an, CASE WHEN hemi AND sex = 'MALE' THEN n_het + n_homalt ELSE ac END AS ac FROM f""",
)
def _(t):
    r = t.regions
    par = r.withColumn("chrom", F.lit("chrX")).unionByName(r.withColumn("chrom", F.lit("chrY")))
    return fq.stratified_frequencies(t.genotypes, t.sites, t.samples, par).where("pop = 'ALL' AND sex <> 'ALL'").select("vid", "sex", "an", "ac")


@query("population_max_frequency", f"WITH {_STRATA}, q AS (SELECT *, {_FRQ} FROM s) SELECT vid, max(af) AS popmax_af FROM q WHERE pop <> 'ALL' AND sex = 'ALL' GROUP BY vid")
def _(t):
    return fq.popmax(fq.stratified_frequencies(t.genotypes, t.sites, t.samples))


@query(
    "copy_number_distribution",
    """WITH n AS (SELECT vid, rd_cn, count(*) AS n FROM fx_genotypes WHERE rd_cn IS NOT NULL GROUP BY vid, rd_cn),
      m AS (SELECT vid, CAST(sum(n) AS BIGINT) AS cn_number, max(rd_cn) AS mx, CAST(sum(CASE WHEN rd_cn <> 2 THEN n ELSE 0 END) AS BIGINT) AS nonref FROM n GROUP BY vid),
      g AS (SELECT m.vid, k, coalesce(n.n, 0) AS n, cn_number, nonref FROM (SELECT *, unnest(range(0, mx + 1)) AS k FROM m) m LEFT JOIN n ON n.vid = m.vid AND n.rd_cn = m.k)
      SELECT vid, cn_number, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS cn_count, list(round(n / cn_number, 6) ORDER BY k)[1] AS cn0_freq, nonref AS cn_nonref_count, round(nonref / cn_number, 6) AS cn_nonref_freq
      FROM g GROUP BY vid, cn_number, nonref""",
)
def _(t):
    d = fq.copy_number_distribution(t.genotypes)
    return d.withColumn("cn0_freq", F.element_at("cn_freq", 1)).drop("cn_freq")


_COUNTS = """g AS (SELECT s.sample, y.svtype FROM (SELECT DISTINCT sample FROM fx_samples) s, (SELECT DISTINCT svtype FROM fx_sites JOIN fx_carriers USING (vid)) y),
  k AS (SELECT sample, svtype, count(*) AS n FROM fx_carriers JOIN fx_sites USING (vid) GROUP BY sample, svtype),
  c AS (SELECT g.sample, g.svtype, coalesce(k.n, 0) AS n FROM g LEFT JOIN k ON k.sample = g.sample AND k.svtype = g.svtype)"""


@query("count_svtypes_per_sample", f"WITH {_COUNTS} SELECT * FROM c")
def _(t):
    return out.count_svtypes(t.carriers, t.sites, t.samples)


@query(
    "count_svtypes_total",
    """SELECT svtype, count(*) AS n_observations, count(DISTINCT vid) AS n_variants FROM fx_carriers JOIN fx_sites USING (vid) GROUP BY svtype""",
)
def _(t):
    per = t.carriers.groupBy("vid").agg(F.count("*").alias("n")).join(t.sites.select("vid", "svtype"), "vid")
    return per.groupBy("svtype").agg(F.sum("n").alias("n_observations"), F.count("*").alias("n_variants"))


_IQR = """q AS (SELECT svtype, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS md, quantile_cont(n, 0.75) AS q3 FROM c GROUP BY svtype),
  o AS (SELECT sample, c.svtype, n, q1 - 0.25 * (q3 - q1) AS lower, q3 + 0.25 * (q3 - q1) AS upper FROM c JOIN q ON q.svtype = c.svtype WHERE md >= 5 AND (n < q1 - 0.25 * (q3 - q1) OR n > q3 + 0.25 * (q3 - q1)))"""


@query("sample_count_iqr_outliers", f"WITH {_COUNTS}, {_IQR} SELECT * FROM o")
def _(t):
    return out.iqr_outliers(out.count_svtypes(t.carriers, t.sites, t.samples), k=0.25, min_median=5)


@query(
    "sample_count_sd_outliers",
    """WITH g AS (SELECT s.sample, y.chrom, y.svtype FROM (SELECT DISTINCT sample FROM fx_samples) s, (SELECT DISTINCT chrom, svtype FROM fx_sites JOIN fx_carriers USING (vid)) y),
      k AS (SELECT sample, chrom, svtype, count(*) AS n FROM fx_carriers JOIN fx_sites USING (vid) GROUP BY sample, chrom, svtype),
      c AS (SELECT g.sample, g.chrom, g.svtype, coalesce(k.n, 0) AS n FROM g LEFT JOIN k ON k.sample = g.sample AND k.svtype = g.svtype AND k.chrom = g.chrom),
      m AS (SELECT chrom, svtype, median(n) AS md, stddev_samp(n) AS sd FROM c GROUP BY chrom, svtype)
      SELECT c.sample, c.chrom, c.svtype, n, md AS median, round(sd, 6) AS sd FROM c JOIN m ON m.chrom = c.chrom AND m.svtype = c.svtype WHERE n > md + 2 * sd OR n < md - 2 * sd""",
)
def _(t):
    c = out.count_svtypes(t.carriers, t.sites, t.samples, by=("chrom", "svtype"))
    return out.sd_outliers(c, k=2.0).withColumn("sd", r6("sd"))


@query(
    "exclude_outlier_samples",
    f"""WITH {_COUNTS}, {_IQR}, kept AS (SELECT vid, sample, a1, a2 FROM fx_genotypes WHERE sample NOT IN (SELECT sample FROM o))
      SELECT * FROM kept WHERE vid IN (SELECT vid FROM kept WHERE coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0)""",
)
def _(t):
    bad = out.iqr_outliers(out.count_svtypes(t.carriers, t.sites, t.samples), k=0.25, min_median=5)
    return out.exclude_samples(t.genotypes.select("vid", "sample", "a1", "a2"), bad)


@query("sum_counts_per_sample", f"WITH {_COUNTS} SELECT sample, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY sample")
def _(t):
    return out.count_svtypes(t.carriers, t.sites, t.samples).groupBy("sample").agg(F.sum("n").alias("n"))


_TRIO = """tr AS (SELECT p.family, p.sample AS proband, p.father, p.mother FROM fx_ped p WHERE father IN (SELECT sample FROM fx_ped) AND mother IN (SELECT sample FROM fx_ped)),
  tg AS (SELECT vid, proband, max(CASE WHEN g.sample = proband THEN a1 + a2 END) AS p, max(CASE WHEN g.sample = father THEN a1 + a2 END) AS f, max(CASE WHEN g.sample = mother THEN a1 + a2 END) AS m,
    max(CASE WHEN g.sample = proband THEN gq END) AS pq, max(CASE WHEN g.sample = father THEN gq END) AS fqq, max(CASE WHEN g.sample = mother THEN gq END) AS mq
    FROM fx_genotypes g JOIN tr ON g.sample IN (proband, father, mother) GROUP BY vid, proband)"""


@query(
    "mendelian_violation_counts",
    f"""WITH {_TRIO}, c AS (SELECT vid, pcr, CASE WHEN p IS NULL OR f IS NULL OR m IS NULL THEN 'I' WHEN p = 0 AND f = 0 AND m = 0 THEN 'N' WHEN p = 2 AND f = 0 AND m = 0 THEN 'D'
        WHEN p = 0 AND (f = 2 OR m = 2) THEN 'U' WHEN p = 2 AND (f = 0 OR m = 0) THEN 'S' ELSE 'M' END AS k FROM tg JOIN fx_samples s ON s.sample = proband),
      tot AS (SELECT pcr, count(*) AS n FROM tr JOIN fx_samples s ON s.sample = proband GROUP BY pcr),
      x AS (SELECT vid, pcr, count(*) FILTER (k = 'N') AS no_variant, count(*) FILTER (k = 'D') AS apparent_de_novo, count(*) FILTER (k = 'U') AS untransmitted_homozygote,
        count(*) FILTER (k = 'S') AS spontaneous_homozygote, count(*) FILTER (k = 'M') AS mendelian FROM c GROUP BY vid, pcr)
      SELECT x.*, tot.n - no_variant - apparent_de_novo - untransmitted_homozygote - spontaneous_homozygote - mendelian AS incomplete,
        apparent_de_novo + untransmitted_homozygote + spontaneous_homozygote + mendelian AS trios_considered FROM x JOIN tot ON tot.pcr = x.pcr""",
)
def _(t):
    return fam.mendelian_counts(t.genotypes, fam.trios(t.ped), t.samples)


@query(
    "genotype_quality_summary",
    """SELECT vid, pcr, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'NULL' WHEN a1 + a2 = 0 THEN 'REF' ELSE 'NONREF' END AS state, count(*) AS n, min(gq) AS min_gq,
      CAST(floor(quantile_cont(gq, 0.0025)) AS BIGINT) AS q1_gq, CAST(floor(quantile_cont(gq, 0.005)) AS BIGINT) AS median_gq, CAST(floor(quantile_cont(gq, 0.0075)) AS BIGINT) AS q3_gq, max(gq) AS max_gq
      FROM fx_genotypes JOIN fx_samples USING (sample) GROUP BY ALL""",
)
def _(t):
    return fam.genotype_quality_summary(t.genotypes, t.samples)


@query(
    "trio_table",
    f"""WITH {_TRIO} SELECT vid, proband, p AS pro_ac, f AS fa_ac, m AS mo_ac, pq AS pro_gq, fqq AS fa_gq, mq AS mo_gq, svtype, svlen, filter FROM tg JOIN fx_sites USING (vid)
      WHERE p = 1 AND f IS NOT NULL AND m IS NOT NULL""",
)
def _(t):
    return fam.trio_table(t.genotypes, fam.trios(t.ped), t.sites.select("vid", "svtype", "svlen", "filter")).drop("pro_ev", "fa_ev", "mo_ev")


@query(
    "denovo_candidates",
    """WITH tr AS (SELECT sample, father, mother FROM fx_ped WHERE father IS NOT NULL),
      n AS (SELECT vid, count(*) AS n FROM fx_carriers WHERE sample IN (SELECT father FROM tr UNION SELECT mother FROM tr) GROUP BY vid)
      SELECT c.vid, c.sample, coalesce(n.n, 0) AS n_parents FROM fx_carriers c JOIN tr USING (sample) LEFT JOIN n ON n.vid = c.vid
      WHERE NOT EXISTS (SELECT 1 FROM fx_carriers d WHERE d.vid = c.vid AND d.sample IN (tr.father, tr.mother)) AND coalesce(n.n, 0) <= 10""",
)
def _(t):
    return fam.denovo_candidates(t.carriers, fam.trios(t.ped))


@query(
    "clean_pedigree",
    """WITH pr AS (SELECT DISTINCT sample FROM fx_genotypes), k AS (SELECT p.*, f.sample AS pf, m.sample AS pm FROM fx_ped p LEFT JOIN pr f ON f.sample = p.father LEFT JOIN pr m ON m.sample = p.mother
        WHERE p.sample IN (SELECT sample FROM pr) AND (father IS NOT NULL OR mother IS NOT NULL)),
      y AS (SELECT *, CASE WHEN pf IS NOT NULL AND pm IS NOT NULL THEN 'TRIO' WHEN pf IS NOT NULL OR pm IS NOT NULL THEN 'DUO' END AS kind FROM k)
      SELECT concat(kind, '_', CAST(row_number() OVER (PARTITION BY kind ORDER BY family, sample) AS VARCHAR)) AS family, sample AS proband, pf AS father, pm AS mother, sex FROM y WHERE kind IS NOT NULL""",
)
def _(t):
    return fam.clean_pedigree(t.ped, t.genotypes.select("sample"))


@query(
    "frequencies_by_library_type",
    f"""WITH x AS (SELECT vid, pcr, {_CNT} FROM fx_genotypes JOIN fx_samples USING (sample) GROUP BY vid, pcr)
      SELECT vid, max(CASE WHEN pcr = 'PCRPLUS' AND an > 0 THEN round(ac / an, 6) WHEN pcr = 'PCRPLUS' THEN 0.0 END) AS pcrplus_af, max(CASE WHEN pcr = 'PCRMINUS' AND an > 0 THEN round(ac / an, 6) WHEN pcr = 'PCRMINUS' THEN 0.0 END) AS pcrminus_af FROM x GROUP BY vid""",
)
def _(t):
    d = fq.allele_frequencies(t.genotypes.join(t.samples.select("sample", "pcr"), "sample"), by=("vid", "pcr"))
    return d.groupBy("vid").agg(*[F.max(F.when(F.col("pcr") == p, F.col("af"))).alias(f"{p.lower()}_af") for p in ("PCRPLUS", "PCRMINUS")])


@query(
    "variants_per_sample",
    """SELECT c.sample, c.vid, svtype, gq, concat(coalesce(CAST(a1 AS VARCHAR), '.'), '/', coalesce(CAST(a2 AS VARCHAR), '.')) AS gt FROM fx_carriers c JOIN fx_genotypes g ON g.vid = c.vid AND g.sample = c.sample JOIN fx_sites s ON s.vid = c.vid""",
)
def _(t):
    gt = F.concat_ws("/", F.coalesce(F.col("a1").cast("string"), F.lit(".")), F.coalesce(F.col("a2").cast("string"), F.lit(".")))
    g = t.genotypes.where("a1 + a2 > 0").join(t.sites.select("vid", "svtype"), "vid")
    return g.select("sample", "vid", "svtype", "gq", gt.alias("gt"))
