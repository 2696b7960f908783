"""Site and genotype filter queries."""

from pyspark.sql import functions as F

from ..functions.exprs import is_carrier, r6
from ..operators import cleanup as cu
from ..operators import filters as fl
from ..operators import frequency as fq
from .registry import query

_CARR = "(coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0)"


@query("biallelic_sites", "SELECT vid, NOT (svtype = 'CNV' OR contains(alt, ',') OR filter = 'MULTIALLELIC') AS biallelic FROM fx_sites")
def _(t):
    return t.sites.select("vid", fl.is_biallelic().alias("biallelic"))


@query(
    "drop_empty_sites",
    f"""SELECT vid, svtype FROM fx_sites s WHERE CASE WHEN svtype = 'CNV' OR filter = 'MULTIALLELIC' THEN EXISTS (SELECT 1 FROM fx_genotypes g WHERE g.vid = s.vid AND rd_cn <> 2)
        ELSE EXISTS (SELECT 1 FROM fx_genotypes g WHERE g.vid = s.vid AND {_CARR}) END""",
)
def _(t):
    return fl.drop_empty(t.sites, t.genotypes).select("vid", "svtype")


_RULES = """SELECT n_nationkey AS cond_id, CASE n_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 2000 WHEN 3 THEN 5000 ELSE 20000 END AS min_svlen,
    CASE n_nationkey % 5 WHEN 0 THEN 500 WHEN 1 THEN 2000 WHEN 2 THEN 5000 WHEN 3 THEN 20000 ELSE 1000000000 END AS max_svlen,
    0.0 AS min_af, CASE WHEN n_nationkey % 2 = 0 THEN 0.3 ELSE 1.0 END AS max_af,
    CASE CAST(floor(n_nationkey / 5) AS INT) WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP,CNV' WHEN 2 THEN 'INS' WHEN 3 THEN 'INV,CPX' ELSE 'DEL,DUP' END AS svtypes,
    CASE WHEN n_nationkey % 3 = 0 THEN 'PASS' END AS filters, CASE WHEN n_nationkey % 4 = 0 THEN 1 + n_nationkey % 7 END AS ev, (n_nationkey * 7) % 50 AS min_gq FROM nation"""
_AF = """af AS (SELECT vid, CASE WHEN sum(CASE WHEN a1 IS NULL THEN 0 ELSE 2 END) > 0 THEN round(sum(coalesce(a1, 0) + coalesce(a2, 0)) / sum(CASE WHEN a1 IS NULL THEN 0 ELSE 2 END), 6) ELSE 0.0 END AS af FROM fx_genotypes GROUP BY vid)"""
_MINGQ = f"""WITH rules AS ({_RULES}), {_AF}, rx AS (SELECT r.*, unnest(string_split(svtypes, ',')) AS ty FROM rules r),
  sx AS (SELECT s.vid, cond_id, ev, min_gq FROM fx_sites s JOIN af USING (vid) JOIN rx ON rx.ty = s.svtype AND svlen >= min_svlen AND svlen < max_svlen
    AND least(CAST(round_even(af * 10000, 0) AS BIGINT), 9999) >= floor(min_af * 10000) AND least(CAST(round_even(af * 10000, 0) AS BIGINT), 9999) < ceil(max_af * 10000) AND (filters IS NULL OR filters = filter)),
  g AS (SELECT g.*, coalesce((SELECT min_by(sx.min_gq, sx.cond_id) FROM sx WHERE sx.vid = g.vid AND (sx.ev IS NULL OR sx.ev = g.ev)), 0) AS need FROM fx_genotypes g),
  d AS (SELECT *, NOT coalesce(a1 = 1 AND a2 = 1, false) AND gq < need AS dropped FROM g)"""


def _min_gq(t):
    af = fq.allele_frequencies(t.genotypes).select("vid", "af")
    return fl.min_gq_filter(t.sites.join(af, "vid"), t.genotypes, t.sql(_RULES))


@query("min_gq_filter_genotypes", f"{_MINGQ} SELECT vid, sample, CASE WHEN dropped THEN NULL ELSE a1 END AS a1, CASE WHEN dropped THEN NULL ELSE a2 END AS a2, gq FROM d")
def _(t):
    return _min_gq(t)[0].select("vid", "sample", "a1", "a2", "gq")


@query(
    "min_gq_filter_sites",
    f"""{_MINGQ}, r AS (SELECT vid, count(*) FILTER (dropped) / count(*) AS r FROM d GROUP BY vid)
      SELECT s.vid, round(r, 2) AS min_gq_ncr, CASE WHEN r > 0.005 THEN CASE WHEN filter = 'PASS' THEN 'COHORT' WHEN filter < 'COHORT' THEN concat(filter, ',COHORT') ELSE concat('COHORT,', filter) END ELSE filter END AS filter
      FROM fx_sites s JOIN r USING (vid)""",
)
def _(t):
    return _min_gq(t)[1].select("vid", "min_gq_ncr", "filter")


@query(
    "call_rate_filter",
    f"""WITH a AS (SELECT vid, avg(CASE WHEN a1 IS NULL AND a2 IS NULL THEN 0.0 ELSE 1.0 END) AS cr, median(CASE WHEN {_CARR} THEN CASE WHEN a1 > 0 AND a2 > 0 THEN 99 ELSE gq END END) AS q, count(*) FILTER ({_CARR}) AS c FROM fx_genotypes GROUP BY vid),
      f AS (SELECT s.vid, CAST(floor(q) AS BIGINT) AS qual, CASE WHEN filter IN ('HIGH_SR_BACKGROUND', 'UNRESOLVED') THEN 'PASS' ELSE filter END AS filter, round(cr, 6) AS call_rate,
        cr < CASE WHEN svtype = 'DEL' AND svlen > 300 AND svlen < 1000 THEN 0.95 ELSE 0.85 END AS low FROM fx_sites s JOIN a USING (vid) WHERE c > 0)
      SELECT vid, qual, call_rate, CASE WHEN NOT low THEN filter WHEN filter = 'PASS' THEN 'LOW_CALL_RATE' ELSE concat('LOW_CALL_RATE,', filter) END AS filter FROM f""",
)
def _(t):
    return fl.call_rate_filter(t.sites, t.genotypes).select("vid", "qual", r6("call_rate").alias("call_rate"), "filter")


@query(
    "large_sr_only_filter",
    """WITH f AS (SELECT vid, count(*) FILTER (rd_cn = 2 AND pe_gt = 0 AND pe_gq % 100 = 99 AND sr_gt <> 0) / count(*) AS f FROM fx_genotypes GROUP BY vid)
      SELECT s.vid, CASE WHEN filter = 'PASS' AND svlen > 500 AND f > 0.01 THEN 'LARGE_SR_ONLY' ELSE filter END AS filter FROM fx_sites s LEFT JOIN f USING (vid)""",
)
def _(t):
    g = t.genotypes.withColumn("pe_gq", F.col("pe_gq") % 100)
    return fl.large_sr_only(t.sites, g, frac=0.01).select("vid", "filter")


@query(
    "common_sites_for_pca",
    """WITH a AS (SELECT vid, avg(CASE WHEN a1 IS NULL AND a2 IS NULL THEN 0.0 ELSE 1.0 END) AS cr, sum(coalesce(a1, 0) + coalesce(a2, 0)) / nullif(sum(CASE WHEN a1 IS NULL AND a2 IS NULL THEN 0 ELSE 2 END), 0) AS af FROM fx_genotypes GROUP BY vid)
      SELECT vid, round(cr, 6) AS call_rate, round(af, 6) AS af FROM fx_sites JOIN a USING (vid) WHERE filter = 'PASS' AND chrom NOT IN ('chrX', 'chrY') AND cr >= 0.9 AND af >= 0.01""",
)
def _(t):
    return fl.common_for_pca(t.sites, t.genotypes, min_rate=0.9).select("vid", r6("call_rate").alias("call_rate"), r6("af").alias("af"))


@query(
    "bothside_support_tag",
    """WITH ids AS (SELECT vid FROM fx_genotypes GROUP BY vid HAVING sum(CASE WHEN sr_gt > 0 THEN 1 ELSE 0 END) > 9)
      SELECT vid, CASE WHEN vid NOT IN (SELECT vid FROM ids) THEN filter WHEN filter = 'PASS' THEN 'BOTHSIDES_SUPPORT' ELSE concat('BOTHSIDES_SUPPORT,', filter) END AS filter FROM fx_sites""",
)
def _(t):
    ids = t.genotypes.groupBy("vid").agg(F.count_if(F.col("sr_gt") > 0).alias("n")).where("n > 9")
    return fl.tag_listed(t.sites, ids, "BOTHSIDES_SUPPORT").select("vid", "filter")


_SCORES = """SELECT concat('v', CAST(p_partkey AS STRING)) AS vid, ((p_partkey * 37) % 100) / 100.0 AS score, CASE p_partkey % 4 WHEN 0 THEN 'BND' WHEN 1 THEN 'INV' ELSE 'DEL' END AS adj_svtype,
   ((p_partkey * 3) % 100) / 100.0 AS baf_prob, ((p_partkey * 7) % 100) / 100.0 AS pe_prob, ((p_partkey * 11) % 100) / 100.0 AS rd_prob, ((p_partkey * 13) % 100) / 100.0 AS sr_prob FROM part"""


@query(
    "score_filter",
    f"""WITH sc AS ({_SCORES}) SELECT vid, CASE WHEN adj_svtype IN ('BND', 'INV', 'INS') AND svtype IN ('DEL', 'DUP') THEN 'BND' ELSE svtype END AS svtype, score,
      concat_ws(',', CASE WHEN baf_prob >= 0.5 THEN 'BAF' END, CASE WHEN pe_prob >= 0.5 THEN 'PE' END, CASE WHEN rd_prob >= 0.5 THEN 'RD' END, CASE WHEN sr_prob >= 0.5 THEN 'SR' END) AS evidence
      FROM fx_sites JOIN sc USING (vid) WHERE score >= 0.5""",
)
def _(t):
    d = fl.score_filter(t.sites.drop("evidence"), t.sql(_SCORES.replace("/ 100.0", "/ CAST(100.0 AS DOUBLE)")))
    return d.select("vid", "svtype", "score", "evidence")


_MSC = "SELECT name, ((l_orderkey * 31 + l_partkey) % 100) / CAST(100.0 AS DOUBLE) AS score FROM (SELECT l_orderkey, l_partkey, concat('m', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS name FROM lineitem) z"


@query(
    "common_site_rescue",
    f"WITH sc AS ({_MSC}) SELECT sc.name, CASE WHEN pe_log_pval > 9.0 OR sr_log_pval > 10.0 THEN 0.51 ELSE score END AS score FROM sc JOIN fx_metrics m ON m.name = sc.name",
)
def _(t):
    return fl.rescue_common(t.sql(_MSC), t.metrics, {"pe_log_pval": 9.0, "sr_log_pval": 10.0})


_SRM = """SELECT concat('v', CAST(p_partkey AS STRING)) AS vid, CAST((p_partkey * 7) % 100 AS DOUBLE) AS sr_sum_log_pval, CAST((p_partkey * 3) % 10 AS DOUBLE) / 10 AS sr_sum_bg_frac,
   1 + (p_partkey * 9973) % 2000000 + p_size % 7 AS sr_pos_a, 1 + (p_partkey * 9973) % 2000000 + p_size * p_size * 20 - p_size % 5 AS sr_pos_b FROM part"""


@query(
    "rewrite_split_read_coordinates",
    f"""WITH m AS ({_SRM}), d AS (SELECT s.*, sr_sum_log_pval >= 30 AND sr_sum_bg_frac >= 0.3 AS ok, sr_pos_a, sr_pos_b FROM fx_sites s JOIN m USING (vid)),
      e AS (SELECT vid, svtype, CASE WHEN NOT ok THEN pos WHEN svtype = 'INV' THEN least(sr_pos_a, sr_pos_b) ELSE sr_pos_a END AS pos, CASE WHEN NOT ok THEN stop WHEN svtype = 'INV' THEN greatest(sr_pos_a, sr_pos_b) ELSE sr_pos_b END AS stop, svlen, ok FROM d),
      f AS (SELECT vid, svtype, pos, stop, CASE WHEN ok AND svtype NOT IN ('INS', 'BND') THEN stop - pos ELSE svlen END AS svlen FROM e)
      SELECT * FROM f WHERE NOT (svtype IN ('DEL', 'DUP') AND svlen < 50)""",
)
def _(t):
    return fl.rewrite_coordinates(t.sites, t.sql(_SRM), 30.0, 0.3).select("vid", "svtype", "pos", "stop", "svlen")


@query(
    "hard_evidence_filter",
    """WITH m AS (SELECT *, pe_log_pval > 3.04 OR sr_log_pval > 2.17 OR pe_log_pval + sr_log_pval > 5.21 AS pesr,
        rd_median_separation > 0.30 AND rd_log_pval > 3.47 AND rd_log_2nd_max_p > 0 AS rd1, algorithms = 'depth' AS dep FROM fx_metrics),
      c AS (SELECT name, CASE WHEN svtype = 'DEL' AND svsize > 5000 AND rd_median_separation > 0.5 AND rd_log_pval > 9.41 AND rd_log_2nd_max_p > 0 THEN 'CNV'
        WHEN svtype = 'DUP' AND svsize >= 5000 AND rd_median_separation > 0.4 AND rd_log_pval > 12.7 AND rd_log_2nd_max_p > 0.11 THEN 'CNV'
        WHEN NOT dep AND pesr AND svtype IN ('DEL', 'DUP') AND (svsize < 1000 OR rd1) THEN 'CNV' WHEN NOT dep AND pesr THEN 'BCA' END AS pass_class FROM m)
      SELECT * FROM c WHERE pass_class IS NOT NULL""",
)
def _(t):
    return fl.hard_filter(t.metrics).select("name", "pass_class")


@query(
    "common_site_subset",
    """WITH n AS (SELECT vid, count(*) AS n_carriers FROM fx_carriers GROUP BY vid)
      SELECT vid, svtype, n_carriers FROM fx_sites JOIN n USING (vid) WHERE n_carriers > 20 / 2 - 1 AND (svtype NOT IN ('DEL', 'DUP') OR abs(stop - pos) < 5000)""",
)
def _(t):
    return fl.common_sites(t.sites, t.carriers, 20, 5000).select("vid", "svtype", "n_carriers")


@query(
    "zero_common_background",
    """SELECT name, CASE WHEN vf > 0.25 AND sr_called_median > 0 AND pe_called_median > 0 THEN 0.0 ELSE CAST(sr_bg_median AS DOUBLE) END AS sr_bg_median, CASE WHEN vf > 0.25 AND sr_called_median > 0 AND pe_called_median > 0 THEN 0.0 ELSE CAST(pe_bg_median AS DOUBLE) END AS pe_bg_median FROM fx_metrics""",
)
def _(t):
    hit = (F.col("vf") > 0.25) & (F.col("sr_called_median") > 0) & (F.col("pe_called_median") > 0)
    m = t.sql("SELECT name, CAST(vf AS DOUBLE) AS vf, CAST(sr_called_median AS DOUBLE) AS sr_called_median, CAST(pe_called_median AS DOUBLE) AS pe_called_median, CAST(sr_bg_median AS DOUBLE) AS sr_bg_median, CAST(pe_bg_median AS DOUBLE) AS pe_bg_median FROM fx_metrics")
    return m.select("name", *[F.when(hit, 0.0).otherwise(F.col(c)).alias(c) for c in ("sr_bg_median", "pe_bg_median")])


@query(
    "carry_filter_results",
    f"""WITH n AS (SELECT vid, count(*) FILTER ({_CARR}) AS c FROM fx_genotypes GROUP BY vid),
      kept AS (SELECT vid, filter FROM fx_sites WHERE qual >= 300), gq AS (SELECT vid FROM fx_sites WHERE qual < 100), ol AS (SELECT vid FROM n WHERE c < 5)
      SELECT s.vid, coalesce(kept.filter, CASE WHEN gq.vid IS NOT NULL THEN 'FAIL_MINGQ' END, CASE WHEN ol.vid IS NOT NULL THEN 'FAIL_OUTLIER' END, 'FAIL_RECALIBRATION') AS filter
      FROM fx_sites s LEFT JOIN kept USING (vid) LEFT JOIN gq ON gq.vid = s.vid LEFT JOIN ol ON ol.vid = s.vid""",
)
def _(t):
    few = t.genotypes.groupBy("vid").agg(F.count_if(is_carrier()).alias("c")).where("c < 5")
    s = t.sites
    return fl.carry_filters(s, s.where("qual >= 300"), [(s.where("qual < 100"), "FAIL_MINGQ"), (few, "FAIL_OUTLIER")], "FAIL_RECALIBRATION").select("vid", "filter")


_EDITS = """SELECT CASE WHEN s_suppkey % 4 = 3 THEN concat('new', CAST(s_suppkey AS STRING)) ELSE concat('v', CAST(s_suppkey AS STRING)) END AS name,
   CASE s_suppkey % 4 WHEN 0 THEN 'add-samples' WHEN 1 THEN 'flag-mosaic' WHEN 2 THEN 'remove-variant' ELSE 'add-variant' END AS operation,
   concat('S', CAST(s_suppkey % 40 AS STRING), ',S', CAST((s_suppkey + 7) % 40 AS STRING)) AS samples, 'chr1' AS chrom, s_suppkey * 1000 AS start, s_suppkey * 1000 + 700 AS stop,
   CASE WHEN s_suppkey % 8 = 3 THEN 'DEL' ELSE 'DUP' END AS svtype FROM supplier"""


@query(
    "curated_edits_sites",
    f"""WITH e AS ({_EDITS}), b AS (SELECT vid, chrom, pos, stop, svtype, strands, svlen FROM fx_sites WHERE vid NOT IN (SELECT name FROM e WHERE operation = 'remove-variant')
        UNION ALL SELECT name, chrom, start, stop, svtype, CASE WHEN svtype = 'DEL' THEN '+-' ELSE '-+' END, stop - start FROM e WHERE operation = 'add-variant')
      SELECT b.*, e.samples AS mosaic FROM b LEFT JOIN e ON e.name = b.vid AND operation = 'flag-mosaic'""",
)
def _(t):
    return fl.apply_edits(t.sites, t.genotypes, t.sql(_EDITS))[0]


@query(
    "curated_edits_genotypes",
    f"""WITH e AS ({_EDITS}), h AS (SELECT name AS vid, unnest(string_split(samples, ',')) AS sample FROM e WHERE operation <> 'remove-variant'),
      g AS (SELECT vid, sample, a1, a2 FROM fx_genotypes WHERE vid NOT IN (SELECT name FROM e WHERE operation = 'remove-variant'))
      SELECT coalesce(g.vid, h.vid) AS vid, coalesce(g.sample, h.sample) AS sample, CASE WHEN h.vid IS NOT NULL THEN 0 ELSE a1 END AS a1, CASE WHEN h.vid IS NOT NULL THEN 1 ELSE a2 END AS a2
      FROM g FULL JOIN (SELECT DISTINCT * FROM h) h ON h.vid = g.vid AND h.sample = g.sample""",
)
def _(t):
    return fl.apply_edits(t.sites, t.genotypes, t.sql(_EDITS))[1]


@query(
    "sample_qc_flag",
    """WITH m AS (SELECT sample, median(cov) AS m FROM fx_bincov GROUP BY sample), bad AS (SELECT count(*) AS n FROM m WHERE m > 90)
      SELECT vid, CASE WHEN n > 0 THEN CASE WHEN filter = 'PASS' THEN 'COVERAGE_OUTLIER' ELSE concat('COVERAGE_OUTLIER,', filter) END ELSE filter END AS filter FROM fx_sites, bad""",
)
def _(t):
    bad = t.bincov.groupBy("sample").agg(F.percentile("cov", F.lit(0.5)).alias("m")).where("m > 90")
    return fl.flag_samples(t.sites, bad, "COVERAGE_OUTLIER").select("vid", "filter")


@query(
    "depth_calls_without_panel_match",
    """WITH c AS (SELECT * FROM fx_calls WHERE sample = 'S1'), p AS (SELECT * FROM fx_calls WHERE sample <> 'S1')
      SELECT name FROM c a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.chrom = b.chrom AND a.svtype = b.svtype AND a.start < b.stop AND b.start < a.stop
        AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.5 * (a.stop - a.start) AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.5 * (b.stop - b.start))""",
)
def _(t):
    c = t.calls
    return fl.depth_without_panel_match(c.where("sample = 'S1'"), c.where("sample <> 'S1'")).select("name")


@query(
    "demote_cnv_without_depth",
    """WITH u AS (SELECT chrom, svtype, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, svtype ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM
        (SELECT *, max(stop) OVER (PARTITION BY chrom, svtype ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_calls WHERE stop - start < 1000) a) b GROUP BY chrom, svtype, i),
      c AS (SELECT vid, coalesce(sum(least(s.stop, u.stop) - greatest(s.pos, u.start)), 0) / (max(s.stop) - max(s.pos)) AS cov FROM fx_sites s JOIN u ON u.chrom = s.chrom AND u.svtype = s.svtype AND s.pos < u.stop AND u.start < s.stop
        WHERE s.svtype IN ('DEL', 'DUP') AND svlen >= 5000 GROUP BY vid)
      SELECT s.vid, CASE WHEN s.svtype IN ('DEL', 'DUP') AND svlen >= 5000 AND coalesce(cov, 0) < 0.5 THEN 'BND' ELSE s.svtype END AS svtype FROM fx_sites s LEFT JOIN c USING (vid)""",
)
def _(t):
    return fl.demote_without_depth(t.sites, t.calls.where("stop - start < 1000")).select("vid", "svtype")


@query(
    "panel_coverage_filter",
    """WITH c AS (SELECT *, 1 + start % 2 AS ac FROM fx_calls), a AS (SELECT * FROM c WHERE sample = 'S1'), p AS (SELECT * FROM c WHERE sample <> 'S1'),
      s AS (SELECT a.name, sum(least(a.stop, p.stop) - greatest(a.start, p.start)) / (a.stop - a.start) AS covered FROM a JOIN p ON a.chrom = p.chrom AND a.svtype = p.svtype AND a.ac = p.ac AND a.start < p.stop AND p.start < a.stop GROUP BY a.name, a.stop, a.start)
      SELECT name, round(covered, 6) AS covered FROM s WHERE covered >= 0.5""",
)
def _(t):
    c = t.calls.withColumn("ac", 1 + F.col("start") % 2)
    return fl.panel_covered(c.where("sample = 'S1'"), c.where("sample <> 'S1'")).withColumn("covered", r6("covered"))


_DUPS = """SELECT vid, chrom, pos - pos % 20000 AS pos, CASE WHEN stop > 2000000 THEN stop ELSE stop - stop % 20000 END AS stop, chr2, svtype, CASE WHEN svtype = 'DUP' THEN '-+' ELSE '+-' END AS strands, svlen, evidence, algorithms, qual,
   CAST(qual % 4 AS DOUBLE) / 4 AS both_end_support, filter = 'HIGH_SR_BACKGROUND' AS sr_fail FROM fx_sites"""


@query(
    "duplicate_breakpoint_dedup",
    f"""WITH s AS ({_DUPS}), k AS (SELECT vid, count(DISTINCT sample) AS n FROM fx_carriers GROUP BY vid),
      r AS (SELECT s.*, coalesce(k.n, 0) AS freq, CASE WHEN contains(evidence, 'PE') AND contains(evidence, 'SR') AND contains(evidence, 'RD') THEN 1 WHEN contains(evidence, 'PE') AND contains(evidence, 'RD') THEN 2 WHEN contains(evidence, 'PE') AND contains(evidence, 'SR') THEN 3
        WHEN contains(evidence, 'RD') AND contains(evidence, 'SR') THEN 4 WHEN contains(evidence, 'PE') THEN 5 WHEN contains(evidence, 'RD') THEN 6 WHEN contains(evidence, 'SR') THEN 7 ELSE 8 END AS lvl
        FROM s LEFT JOIN k USING (vid) WHERE NOT (svtype IN ('DEL', 'DUP') AND svlen >= 5000)),
      o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN svtype = 'BND' THEN 1 ELSE 0 END, lvl, CASE WHEN contains(algorithms, 'melt') THEN 0 ELSE 1 END, both_end_support DESC, CASE WHEN sr_fail THEN 1 ELSE 0 END, qual DESC, freq DESC, CASE WHEN svlen >= 50 THEN 1 ELSE 0 END, svlen, vid) AS rk FROM r),
      b AS (SELECT DISTINCT vid, freq, rk, concat(chrom, '_', CAST(pos AS VARCHAR), '_', substr(strands, 1, 1)) AS e FROM o UNION SELECT vid, freq, rk, concat(chr2, '_', CAST(stop AS VARCHAR), '_', substr(strands, 2, 1)) FROM o),
      p AS (SELECT DISTINCT x.vid AS a, y.vid AS b, greatest(x.freq, y.freq) AS mx FROM b x JOIN b y ON x.e = y.e AND x.rk < y.rk),
      q AS (SELECT p.*, (SELECT count(*) FROM fx_carriers c JOIN fx_carriers d ON c.sample = d.sample WHERE c.vid = p.a AND d.vid = p.b) AS nb FROM p)
      SELECT DISTINCT b AS vid FROM q WHERE nb >= 0.5 * mx""",
)
def _(t):
    return fl.duplicate_breakpoints(t.sql(_DUPS), t.carriers)


@query(
    "shared_breakend_pairs",
    f"""WITH s AS ({_DUPS}), b AS (SELECT vid, concat(chrom, '_', CAST(pos AS VARCHAR), '_', substr(strands, 1, 1)) AS e FROM s UNION SELECT vid, concat(chr2, '_', CAST(stop AS VARCHAR), '_', substr(strands, 2, 1)) FROM s),
      p AS (SELECT DISTINCT x.vid AS vid_a, y.vid AS vid_b FROM b x JOIN b y ON x.e = y.e AND x.vid < y.vid), k AS (SELECT vid, count(*) AS n FROM fx_carriers GROUP BY vid),
      q AS (SELECT p.*, count(*) AS n_both FROM p JOIN fx_carriers c ON c.vid = vid_a JOIN fx_carriers d ON d.vid = vid_b AND d.sample = c.sample GROUP BY vid_a, vid_b)
      SELECT vid_a, vid_b, n_both FROM q JOIN k ka ON ka.vid = vid_a JOIN k kb ON kb.vid = vid_b WHERE n_both >= 0.5 * greatest(ka.n, kb.n)""",
)
def _(t):
    s = t.sql(_DUPS)
    key = lambda c, p, i: F.concat_ws("_", c, F.col(p).cast("string"), F.substring("strands", i, 1))
    b = s.select("vid", F.explode(F.array_distinct(F.array(key("chrom", "pos", 1), key("chr2", "stop", 2)))).alias("e"))
    from ..operators.cluster import sharing_pairs

    return sharing_pairs(b, t.carriers, 0.5)
