"""minGQ learning, batch effects, de novo statistics and mosaic screens."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..functions.stats import erfc_sql
from ..operators import batch as bt
from ..operators import family as fam
from .eigen import eigen_sql
from .frequency_queries import _TRIO
from .registry import query

_ROWS = f"{_TRIO}, rows_ AS (SELECT tg.vid, tr.family, CASE WHEN f = 0 AND m = 0 THEN 'dn' ELSE 'inh' END AS label, pq, fqq, mq, f AS fa_ac, m AS mo_ac FROM tg JOIN tr USING (proband) WHERE p = 1 AND f IS NOT NULL AND m IS NOT NULL)"


def _rows(t):
    tr = fam.trios(t.ped)
    g = fam.trio_genotypes(t.genotypes, tr).where("pro_ac = 1 AND fa_ac IS NOT NULL AND mo_ac IS NOT NULL").join(tr.select("proband", "family"), "proband")
    return g.withColumn("label", F.when((F.col("fa_ac") == 0) & (F.col("mo_ac") == 0), "dn").otherwise("inh"))


_CURVE = f"""{_ROWS}, gr AS (SELECT CAST(unnest(range(0, 100, 5)) AS INT) AS min_gq), al AS (SELECT family, count(*) FILTER (label = 'inh') AS n FROM rows_ GROUP BY family HAVING count(*) FILTER (label = 'inh') > 0),
  c AS (SELECT family, min_gq, count(*) FILTER (label = 'inh' AND pq > min_gq) AS i, count(*) FILTER (label = 'dn' AND least(pq, fqq, mq) > min_gq) AS d FROM rows_, gr GROUP BY family, min_gq),
  cv AS (SELECT min_gq, median(i) AS inherited, median(i / n) AS inherited_rate, median(d) AS denovo, median(CASE WHEN i + d > 0 THEN d / (i + d) END) AS denovo_rate FROM c JOIN al USING (family) GROUP BY min_gq)"""


@query("min_gq_curve", f"WITH {_CURVE} SELECT min_gq, inherited, round(inherited_rate, 6) AS inherited_rate, denovo, round(denovo_rate, 6) AS denovo_rate FROM cv")
def _(t):
    return bt.min_gq_curve(_rows(t), list(range(0, 100, 5))).withColumns({c: r6(c) for c in ("inherited_rate", "denovo_rate")})


@query("optimal_min_gq", f"WITH {_CURVE} SELECT coalesce(min(CASE WHEN denovo_rate <= 0.25 THEN min_gq END), max(CASE WHEN inherited_rate > 0 THEN min_gq END)) AS min_gq FROM cv")
def _(t):
    return bt.optimal_min_gq(bt.min_gq_curve(_rows(t), list(range(0, 100, 5))), 0.25)


_AF = "af AS (SELECT vid, sum(coalesce(a1, 0) + coalesce(a2, 0)) / nullif(sum(CASE WHEN a1 IS NULL THEN 0 ELSE 2 END), 0) AS af FROM fx_genotypes GROUP BY vid)"


@query(
    "min_gq_condition_strata",
    f"""WITH {_AF}, z AS (SELECT * FROM (VALUES (0, 1000), (1000, 10000), (10000, 1000000)) v(lo, hi)), q AS (SELECT * FROM (VALUES (0.0, 0.3), (0.3, 1.1)) v(a, b)), ty AS (SELECT * FROM (VALUES (0, 'DEL'), (1, 'DUP'), (2, 'INV')) v(k, svtype)),
      c AS (SELECT CAST(row_number() OVER (ORDER BY lo, a, k) - 1 AS INT) AS cond_id, lo, hi, a, b, svtype FROM z, q, ty) SELECT s.vid, cond_id FROM fx_sites s JOIN af USING (vid) JOIN c ON c.svtype = s.svtype AND svlen >= lo AND svlen < hi AND af >= a AND af < b""",
)
def _(t):
    c = bt.condition_strata([(0, 1000), (1000, 10000), (10000, 1000000)], [(0.0, 0.3), (0.3, 1.1)], ["DEL", "DUP", "INV"], t.spark)
    ac, an = F.sum(F.coalesce("a1", F.lit(0)) + F.coalesce("a2", F.lit(0))), F.sum(F.when(F.col("a1").isNull(), 0).otherwise(2))
    af = t.genotypes.groupBy("vid").agg((ac / F.when(an > 0, an)).alias("af"))
    return bt.assign_conditions(t.sites.join(af, "vid"), c).select("vid", "cond_id")


@query("min_gq_tree")
def _(t):
    r = _rows(t).join(t.sites.select("vid", "svtype", "filter", F.when(F.col("svlen") < 5000, "small").otherwise("large").alias("size_class")), "vid")
    leaf = r.groupBy("svtype", "filter", "size_class").agg(F.count_if(F.col("label") == "inh").alias("retained"), F.percentile("pro_gq", F.lit(0.5)).alias("m"))
    leaf = leaf.select("svtype", "filter", "size_class", "retained", F.when(F.col("retained") > 20, F.floor("m").cast("int")).alias("min_gq"))
    return bt.min_gq_tree(leaf, ["svtype", "filter", "size_class"])[1]


_BF = "bf AS (SELECT vid, batch, pop, sum(CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END) AS an, sum(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS ac FROM fx_genotypes JOIN fx_samples USING (sample) GROUP BY vid, batch, pop)"


@query("batch_frequency_table", f"WITH {_BF} SELECT vid, batch, pop, CAST(an AS BIGINT) AS an, CAST(ac AS BIGINT) AS ac FROM bf")
def _(t):
    return bt.batch_frequencies(t.genotypes, t.samples)


_TEST = """d1 AS (SELECT *, CASE WHEN greatest(ac1, ac2) < 1 THEN 0 ELSE least(an1, an2) END AS m FROM d0), d2 AS (SELECT * FROM d1 WHERE m > 2 QUALIFY row_number() OVER (PARTITION BY vid, b1, b2 ORDER BY m DESC, pop) = 1),
  d3 AS (SELECT *, least(ac1, an1) AS c1, least(ac2, an2) AS c2 FROM d2), d4 AS (SELECT *, (an1 - c1 + c1 + an2 - c2 + c2) AS n, CAST((an1 - c1) * c2 - c1 * (an2 - c2) AS DOUBLE) AS det, CAST(an1 AS DOUBLE) * an2 * ((an1 - c1) + (an2 - c2)) * (c1 + c2) AS den FROM d3),
  d5 AS (SELECT vid, b1, b2, pop, round(c1 / an1, 6) AS af1, round(c2 / an2, 6) AS af2, CASE WHEN den > 0 THEN n * pow(greatest(abs(det) - n / 2.0, 0), 2) / den END AS chisq FROM d4)"""
_OUT = f"SELECT vid, b1, b2, pop, af1, af2, round(chisq, 5) AS chisq, round({erfc_sql('sqrt(chisq / 2.0)')}, 5) AS p FROM d5"


def _rt(d):
    return d.withColumns({"af1": r6("af1"), "af2": r6("af2"), "chisq": F.round("chisq", 5), "p": F.round("p", 5)})


@query("batch_effect_pairwise", f"WITH {_BF}, d0 AS (SELECT a.vid, a.pop, a.batch AS b1, b.batch AS b2, a.an AS an1, a.ac AS ac1, b.an AS an2, b.ac AS ac2 FROM bf a JOIN bf b ON a.vid = b.vid AND a.pop = b.pop AND a.batch < b.batch), {_TEST} {_OUT}")
def _(t):
    return _rt(bt.batch_effect_tests(bt.batch_frequencies(t.genotypes, t.samples), 2))


@query("batch_effect_one_vs_all", f"WITH {_BF}, tt AS (SELECT vid, pop, sum(an) AS tan, sum(ac) AS tac FROM bf GROUP BY vid, pop), d0 AS (SELECT bf.vid, bf.pop, batch AS b1, 'ALL_OTHERS' AS b2, an AS an1, ac AS ac1, tan - an AS an2, tac - ac AS ac2 FROM bf JOIN tt ON tt.vid = bf.vid AND tt.pop = bf.pop), {_TEST} {_OUT}")
def _(t):
    return _rt(bt.batch_effect_tests(bt.batch_frequencies(t.genotypes, t.samples), 2, True))


_FAIL = "SELECT concat('v', CAST(p_partkey AS STRING)) AS vid, p_partkey % 20 AS fails_pairwise, p_partkey % 4 AS fails_onevsall, CAST(p_partkey % 10 AS DOUBLE) / 20 AS plus_pairwise, CAST(p_partkey % 7 AS DOUBLE) / 20 AS plus_onevsall, CAST(p_partkey % 9 AS DOUBLE) / 9 AS pcrplus_af, CAST(p_partkey % 11 AS DOUBLE) / 11 AS pcrminus_af FROM part"
_RC = f"fl AS ({_FAIL}), rc AS (SELECT vid, CASE WHEN CASE WHEN fails_pairwise >= 12 AND fails_onevsall >= 2 THEN greatest(plus_pairwise, plus_onevsall) WHEN fails_pairwise >= 12 THEN plus_pairwise ELSE plus_onevsall END >= 0.11 THEN CASE WHEN pcrplus_af >= pcrminus_af THEN 'PCRPLUS_ENRICHED' ELSE 'PCRPLUS_DEPLETED' END ELSE 'VARIABLE_ACROSS_BATCHES' END AS classification FROM fl WHERE fails_pairwise >= 12 OR fails_onevsall >= 2)"


def _classes(t):
    f = t.sql(_FAIL)
    return bt.reclassify_batch_effects(f.drop("pcrplus_af", "pcrminus_af"), f.select("vid", "pcrplus_af", "pcrminus_af"))


@query("batch_effect_reclassification", f"WITH {_RC} SELECT * FROM rc")
def _(t):
    return _classes(t)


@query("apply_batch_effect_labels", f"WITH {_RC}, g AS (SELECT g.vid, g.sample, a1, a2, coalesce((classification = 'PCRPLUS_ENRICHED' AND pcr <> 'PCRPLUS') OR (classification = 'PCRPLUS_DEPLETED' AND pcr = 'PCRPLUS'), false) AS x FROM fx_genotypes g JOIN fx_samples s USING (sample) LEFT JOIN rc ON rc.vid = g.vid) SELECT vid, sample, CASE WHEN NOT x THEN a1 END AS a1, CASE WHEN NOT x THEN a2 END AS a2 FROM g")
def _(t):
    return bt.apply_batch_labels(t.genotypes, t.samples, _classes(t))


@query("batch_frequency_correlation", f"WITH {_BF}, f AS (SELECT vid, pop, batch, ac / an AS af FROM bf WHERE an > 0) SELECT a.pop, a.batch AS b1, b.batch AS b2, count(*) AS n, round(corr(a.af, b.af), 6) AS r FROM f a JOIN f b ON a.vid = b.vid AND a.pop = b.pop AND a.batch < b.batch GROUP BY a.pop, a.batch, b.batch")
def _(t):
    return bt.batch_correlation(bt.batch_frequencies(t.genotypes, t.samples)).withColumn("r", r6("r"))


_FQ = "SELECT vid, sum(CASE WHEN a1 IS NULL THEN 0 ELSE 2 END) AS an, sum(coalesce(a1, 0) + coalesce(a2, 0)) AS ac FROM fx_genotypes WHERE {w} GROUP BY vid"


@query(
    "frequencies_before_after_filter",
    f"""WITH b AS ({_FQ.format(w='true')}), a AS ({_FQ.format(w='gq >= 40')}), x AS (SELECT b.vid, b.an AS an1, b.ac AS c1, a.an AS an2, a.ac AS c2 FROM b JOIN a USING (vid)), y AS (SELECT *, an1 + an2 AS n, CAST((an1 - c1) * c2 - c1 * (an2 - c2) AS DOUBLE) AS det, CAST(an1 AS DOUBLE) * an2 * ((an1 - c1) + (an2 - c2)) * (c1 + c2) AS den FROM x)
      SELECT vid, CASE WHEN an1 > 0 THEN round(c1 / an1, 6) END AS af_before, CASE WHEN an2 > 0 THEN round(c2 / an2, 6) END AS af_after, round(CASE WHEN den > 0 THEN n * pow(greatest(abs(det) - n / 2.0, 0), 2) / den END, 5) AS chisq FROM y""",
)
def _(t):
    d = bt.compare_before_after(t.sql(_FQ.format(w="true")), t.sql(_FQ.format(w="gq >= 40")))
    return d.select("vid", r6("af_before").alias("af_before"), r6("af_after").alias("af_after"), F.round("chisq", 5).alias("chisq"))


@query("allele_dosage", "SELECT vid, sample, a1 + a2 AS dosage FROM fx_genotypes WHERE a1 IS NOT NULL AND a2 IS NOT NULL")
def _(t):
    return bt.allele_dosage(t.genotypes)


_DOSE = "ds AS (SELECT vid, sample, a1 + a2 AS d FROM fx_genotypes WHERE a1 IS NOT NULL AND a2 IS NOT NULL), cd AS (SELECT vid, sample, d - avg(d) OVER (PARTITION BY vid) AS v FROM ds), g0 AS MATERIALIZED (SELECT x.sample AS a, y.sample AS b, sum(x.v * y.v) AS v FROM cd x JOIN cd y ON y.vid = x.vid GROUP BY 1, 2)"


@query("dosage_components", f"WITH {_DOSE}, {eigen_sql('g0', 3)} SELECT a AS sample, component, round(value, 4) AS value FROM eig")
def _(t):
    return bt.dosage_components(bt.allele_dosage(t.genotypes), 3).withColumn("value", F.round("value", 4))


@query("ancestry_labels")
def _(t):
    pc = bt.dosage_components(bt.allele_dosage(t.genotypes), 3)
    return bt.label_ancestry(pc, t.samples.where("batch <> 'B2'"))


@query("prune_related_samples")
def _(t):
    p = t.orders.select(F.concat(F.lit("C"), (F.col("o_custkey") % 997).cast("string")).alias("a"), F.concat(F.lit("C"), (F.col("o_orderkey") % 991).cast("string")).alias("b")).where("a <> b").distinct()
    return bt.prune_related(p.where("substring(a, 2, 1) = substring(b, 2, 1)"))


_MO = "SELECT name, svtype, svsize, poor_region_cov, CAST(rd_log_pval AS DOUBLE) AS rd_log_pval, CAST(rd_median_separation AS DOUBLE) AS rd_median_separation, 1 + svsize % 3 AS n_carriers FROM fx_metrics"


@query(
    "mosaic_candidates",
    f"""WITH m AS ({_MO}), ok AS (SELECT * FROM m WHERE n_carriers = 1 AND svsize >= 5000 AND poor_region_cov < 0.3 AND rd_log_pval >= 5), q AS (SELECT svtype, quantile_cont(rd_median_separation, 0.25) AS a, quantile_cont(rd_median_separation, 0.75) AS b FROM ok GROUP BY svtype)
      SELECT ok.name, ok.svtype, rd_median_separation FROM ok JOIN q USING (svtype) WHERE rd_median_separation < a - 1.5 * (b - a) OR rd_median_separation < 0.2""",
)
def _(t):
    return bt.mosaic_candidates(t.sql(_MO), 5.0, 0.2).select("name", "svtype", "rd_median_separation")


@query(
    "denovo_metric_filter",
    """WITH x AS (SELECT g.vid, family, g.sample, p.father IS NOT NULL AS kid, rd_gq, pe_gq FROM fx_genotypes g JOIN fx_ped p USING (sample)), mx AS (SELECT vid, family, max(rd_gq) AS r, max(pe_gq) AS q FROM x WHERE NOT kid GROUP BY vid, family)
      SELECT x.vid, x.sample, (rd_gq >= 300 AND pe_gq >= 300) AND NOT coalesce(r >= 300 AND q >= 300, false) AS denovo_pass FROM x LEFT JOIN mx ON mx.vid = x.vid AND mx.family = x.family WHERE kid""",
)
def _(t):
    x = t.genotypes.join(t.ped.select("sample", "family", "father"), "sample").select("vid", "family", "sample", "father", "rd_gq", "pe_gq")
    return bt.denovo_metric_filter(x.where("father IS NOT NULL"), x.where("father IS NULL"), {"rd_gq": 300, "pe_gq": 300}).select("vid", "sample", "denovo_pass")


@query("inheritance_summary", f"WITH {_ROWS} SELECT svtype, filter, count(*) AS n, count(*) FILTER (label = 'dn') AS n_denovo, count(*) FILTER (label = 'inh') AS n_inherited, round(count(*) FILTER (label = 'dn') / count(*), 6) AS denovo_rate FROM rows_ JOIN fx_sites USING (vid) GROUP BY svtype, filter")
def _(t):
    return bt.inheritance_summary(_rows(t).join(t.sites.select("vid", "svtype", "filter"), "vid"), ["svtype", "filter"]).withColumn("denovo_rate", r6("denovo_rate"))


@query(
    "low_quality_site_categories",
    f"""WITH {_TRIO}, c AS (SELECT vid, count(*) FILTER (NOT (p = 0 AND f = 0 AND m = 0)) AS tc, count(*) FILTER (NOT (p = 0 AND f = 0 AND m = 0) AND NOT (p = 2 AND f = 0 AND m = 0) AND NOT (p = 0 AND (f = 2 OR m = 2)) AND NOT (p = 2 AND (f = 0 OR m = 0))) AS md FROM tg WHERE p IS NOT NULL AND f IS NOT NULL AND m IS NOT NULL GROUP BY vid)
      SELECT svtype, filter, CASE WHEN svlen < 5000 THEN 'small' ELSE 'large' END AS size_class, count(*) AS n, count(*) FILTER (1 - md / tc > 0.05) AS n_high, round(count(*) FILTER (1 - md / tc > 0.05) / count(*), 6) AS frac_high FROM c JOIN fx_sites USING (vid) WHERE tc > 0 GROUP BY 1, 2, 3""",
)
def _(t):
    c = fam.trio_genotypes(t.genotypes, fam.trios(t.ped), ()).withColumn("cls", fam.transmission_class())
    r = c.groupBy("vid").agg(F.count_if(~F.col("cls").isin("INCOMPLETE", "NO_VARIANT")).alias("trios_considered"), F.count_if(F.col("cls") == "MENDELIAN").alias("mendelian"))
    r = r.join(t.sites.select("vid", "svtype", "filter", F.when(F.col("svlen") < 5000, "small").otherwise("large").alias("size_class")), "vid")
    return bt.low_quality_categories(r).withColumn("frac_high", r6("frac_high"))
