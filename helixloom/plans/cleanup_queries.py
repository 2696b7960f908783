"""Genotype clean-up queries."""

from pyspark.sql import functions as F

from ..functions.exprs import is_carrier
from ..operators import cleanup as cu
from .registry import query

_CARR = "(coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0)"


@query(
    "allosome_genotype_revision",
    """WITH s AS (SELECT vid, svtype, pos, stop, chrom = 'chrY' AS y FROM fx_sites WHERE chrom IN ('chrX', 'chrY')),
      g AS (SELECT g.vid, g.sample, a1, a2, rd_cn, sex, svtype, pos, stop, y FROM fx_genotypes g JOIN s USING (vid) JOIN fx_ped p ON p.sample = g.sample),
      k AS (SELECT vid, sex, count(*) FILTER (least(rd_cn, 3) = 0) AS n0, count(*) FILTER (least(rd_cn, 3) = 1) AS n1, count(*) FILTER (least(rd_cn, 3) = 2) AS n2, count(*) AS n FROM g WHERE rd_cn IS NOT NULL GROUP BY vid, sex),
      m AS (SELECT vid, sex, CASE WHEN 2 * n0 = n THEN 0.5 WHEN 2 * n0 > n THEN 0.0 WHEN 2 * (n0 + n1) = n THEN 1.5 WHEN 2 * (n0 + n1) > n THEN 1.0 WHEN 2 * (n0 + n1 + n2) = n THEN 2.5 WHEN 2 * (n0 + n1 + n2) > n THEN 2.0 ELSE 3.0 END AS md FROM k),
      r AS (SELECT g.*, coalesce(svtype IN ('DEL', 'DUP') AND stop + 1 - pos > 500 AND mm.md = 1 AND ff.md = CASE WHEN y THEN 0 ELSE 2 END, false) AS rev FROM g LEFT JOIN m mm ON mm.vid = g.vid AND mm.sex = 1 LEFT JOIN m ff ON ff.vid = g.vid AND ff.sex = 2),
      d AS (SELECT *, sex = 1 AND rev AND rd_cn IS NOT NULL AS male, CASE WHEN svtype = 'DEL' THEN CASE WHEN rd_cn >= 1 THEN 0 ELSE 1 END WHEN rd_cn <= 1 THEN 0 WHEN rd_cn = 2 THEN 1 ELSE 2 END AS dose FROM r)
      SELECT vid, sample, CAST(CASE WHEN sex = 2 AND y THEN NULL WHEN male THEN CASE WHEN dose = 2 THEN 1 ELSE 0 END ELSE a1 END AS INT) AS a1, CAST(CASE WHEN sex = 2 AND y THEN NULL WHEN male THEN CASE WHEN dose >= 1 THEN 1 ELSE 0 END ELSE a2 END AS INT) AS a2,
        CAST(CASE WHEN sex = 2 AND y THEN NULL WHEN male THEN rd_cn + 1 ELSE rd_cn END AS INT) AS rd_cn, rev AS revised_event FROM d""",
)
def _(t):
    # one copy fewer for males so that some events have the haploid pattern
    return cu.revise_allosomes(t.sites, t.genotypes, t.ped, min_size=500)


@query(
    "overlapping_cnv_revision",
    f"""WITH iv AS (SELECT vid, svtype, chrom, least(pos, stop) - 1 AS start, greatest(pos, stop) AS stop FROM fx_sites),
      p AS (SELECT a.vid AS wide, a.svtype AS wt, a.start AS ws, b.vid AS vid FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.vid <> b.vid AND a.start < b.stop AND b.start < a.stop
        AND a.stop - a.start >= b.stop - b.start AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.5 * (b.stop - b.start)),
      d AS (SELECT p.vid, n.sample, wt, w.rd_cn AS wcn, n.rd_cn AS ncn, n.rd_gq, row_number() OVER (PARTITION BY p.vid, n.sample ORDER BY ws DESC, wide DESC) AS rn
        FROM p JOIN (SELECT * FROM fx_genotypes WHERE {_CARR}) w ON w.vid = wide JOIN (SELECT * FROM fx_genotypes WHERE NOT {_CARR}) n ON n.vid = p.vid AND n.sample = w.sample)
      SELECT vid, sample, rd_gq AS gq FROM d WHERE rn = 1 AND ncn = 2 AND wcn = CASE wt WHEN 'DUP' THEN 3 WHEN 'DEL' THEN 1 END""",
)
def _(t):
    return cu.overlapping_cnv_revisions(t.sites, t.genotypes)


@query(
    "multi_copy_cnv_list",
    """SELECT DISTINCT vid FROM fx_genotypes JOIN fx_sites USING (vid) WHERE svtype IN ('DEL', 'DUP') AND stop - pos + 1 >= 1000 AND ((svtype = 'DEL' AND rd_cn > 3) OR (svtype = 'DUP' AND (rd_cn < 1 OR rd_cn > 4)))""",
)
def _(t):
    return cu.multi_cnv_list(t.sites, t.genotypes)


@query(
    "copy_number_revision_list",
    """WITH RECURSIVE mc AS (SELECT DISTINCT vid FROM fx_genotypes JOIN fx_sites USING (vid) WHERE svtype IN ('DEL', 'DUP') AND stop - pos + 1 >= 1000 AND ((svtype = 'DEL' AND rd_cn > 3) OR (svtype = 'DUP' AND (rd_cn < 1 OR rd_cn > 4)))),
      c AS (SELECT g.vid, sample, chrom, svtype, least(pos, stop) - 1 AS s, greatest(pos, stop) AS e, rd_cn AS cn, (ev & 1) > 0 AS d, (ev & 6) > 0 AS x, coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0 AS called, g.vid IN (SELECT vid FROM mc) AS multi
        FROM fx_genotypes g JOIN fx_sites USING (vid) WHERE svtype IN ('DEL', 'DUP') AND abs(stop - pos) >= 1000 AND CASE WHEN svtype = 'DEL' THEN rd_cn < 2 ELSE rd_cn > 2 END),
      p0 AS (SELECT a.sample, a.vid AS a, b.vid AS b, a.e - a.s AS la, b.e - b.s AS lb, a.s AS sa, b.s AS sb, a.cn AS ca0, b.cn AS cb0,
          CASE WHEN a.d AND a.x AND b.d AND NOT b.x AND NOT a.multi THEN 1 WHEN a.d AND NOT a.x AND b.d AND b.x AND NOT b.multi AND b.called AND least(a.e, b.e) - greatest(a.s, b.s) > 0.5 * (a.e - a.s) THEN 2
               WHEN a.d AND NOT a.x AND b.d AND NOT b.x AND a.svtype = b.svtype AND NOT a.multi THEN 3 WHEN a.d AND b.e - b.s > 5000 AND NOT a.multi THEN 1 END AS rule
        FROM c a JOIN c b ON a.sample = b.sample AND a.chrom = b.chrom AND a.vid <> b.vid AND a.s < b.e AND b.s < a.e WHERE a.called AND (NOT b.called OR a.e - a.s >= b.e - b.s) AND least(a.e, b.e) - greatest(a.s, b.s) > 0.5 * (b.e - b.s)),
      p AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY la DESC, lb DESC, sa, a, sb, b) AS i FROM p0 WHERE rule IS NOT NULL),
      z AS (SELECT DISTINCT sample, 0::BIGINT AS i, MAP {}::MAP(VARCHAR, BIGINT) AS m, []::VARCHAR[] AS nm FROM p
        UNION ALL SELECT sample, i, CASE WHEN act THEN map_concat(m, MAP {t: v}) ELSE m END, CASE WHEN act AND v = 2 THEN list_append(nm, t) ELSE nm END FROM
          (SELECT *, CASE WHEN rule = 2 THEN greatest(ca + 2 - cb, 0) WHEN rule = 3 AND NOT ((ca = 0 AND cb <> 0) OR (ca = 1 AND cb = 0) OR (ca > 1 AND cb > ca)) THEN 2 ELSE greatest(cb + 2 - ca, 0) END AS v FROM
            (SELECT z.sample, p.i, m, nm, rule, CASE WHEN rule = 2 THEN a ELSE b END AS t, NOT list_contains(nm, a) AS act, coalesce(m[a], ca0)::BIGINT AS ca, coalesce(m[b], cb0)::BIGINT AS cb FROM z JOIN p ON p.sample = z.sample AND p.i = z.i + 1))),
      f AS (SELECT sample, m FROM z QUALIFY row_number() OVER (PARTITION BY sample ORDER BY i DESC) = 1)
      SELECT u.key AS vid, sample, u.value::INTEGER AS rd_cn FROM (SELECT sample, unnest(map_entries(m)) AS u FROM f)""",
)
def _(t):
    return cu.copy_number_revisions(t.sites, t.genotypes, cu.multi_cnv_list(t.sites, t.genotypes), min_size=1000)


@query(
    "apply_copy_number_revisions",
    """WITH r AS (SELECT vid, sample, rd_cn FROM fx_genotypes WHERE rd_gq > 900)
      SELECT g.vid, g.sample, CASE WHEN r.vid IS NOT NULL THEN 0 ELSE a1 END AS a1, CASE WHEN r.vid IS NOT NULL THEN 1 ELSE a2 END AS a2, g.rd_cn FROM fx_genotypes g LEFT JOIN r ON r.vid = g.vid AND r.sample = g.sample""",
)
def _(t):
    g = t.genotypes
    return cu.apply_copy_number_revisions(g, g.where("rd_gq > 900")).select("vid", "sample", "a1", "a2", "rd_cn")


@query(
    "overdispersed_genotypes",
    """WITH b AS (SELECT vid, CASE WHEN pe_gt IS NULL THEN NULL WHEN sr_gt IS NULL THEN pe_gt WHEN pe_gt > 0 AND sr_gt = 0 THEN pe_gt WHEN pe_gt = 0 THEN sr_gt WHEN pe_gq >= sr_gq THEN pe_gt ELSE sr_gt END AS gt FROM fx_genotypes)
      SELECT vid, count(*) AS n_over FROM b WHERE gt > 2 GROUP BY vid HAVING count(*) > 2""",
)
def _(t):
    return cu.overdispersed_genotypes(t.genotypes, t.samples.count())


_MULTI = """s AS (SELECT vid, svtype, abs(stop - pos) AS l FROM fx_sites WHERE svtype IN ('DEL', 'DUP')),
  a AS (SELECT vid, svtype, l, count(*) FILTER (rd_cn > 3) AS g3, count(*) FILTER (rd_cn > 4) AS g4 FROM fx_genotypes JOIN s USING (vid) GROUP BY vid, svtype, l),
  f AS (SELECT vid, svtype, l >= 1000 AND CASE WHEN svtype = 'DEL' THEN g3 > 2 ELSE g4 > 2 END AS multiallelic, l >= 5000 AND NOT (l >= 1000 AND CASE WHEN svtype = 'DEL' THEN g3 > 2 ELSE g4 > 2 END) AS regenotyped FROM a)"""


@query("multiallelic_sites", f"WITH {_MULTI} SELECT vid, multiallelic, regenotyped FROM f")
def _(t):
    return cu.resolve_multiallelics(t.sites, t.genotypes, t.samples.count())[0]


@query(
    "multiallelic_genotypes",
    f"""WITH {_MULTI}, g AS (SELECT g.*, f.svtype, multiallelic AS m, regenotyped AND gq IS NOT NULL AND rd_cn IS NOT NULL AS u, CASE WHEN f.svtype = 'DEL' THEN CASE WHEN rd_cn >= 2 THEN 0 WHEN rd_cn = 1 THEN 1 ELSE 2 END WHEN rd_cn <= 2 THEN 0 WHEN rd_cn = 3 THEN 1 ELSE 2 END AS dose FROM fx_genotypes g JOIN f USING (vid))
      SELECT vid, sample, CAST(CASE WHEN m THEN NULL WHEN u THEN CASE WHEN dose = 2 THEN 1 ELSE 0 END ELSE a1 END AS INT) AS a1, CAST(CASE WHEN m THEN NULL WHEN u THEN CASE WHEN dose >= 1 THEN 1 ELSE 0 END ELSE a2 END AS INT) AS a2,
        CASE WHEN NOT m THEN gq END AS gq, CASE WHEN m THEN rd_cn END AS cn, CASE WHEN m THEN rd_gq END AS cnq FROM g""",
)
def _(t):
    return cu.resolve_multiallelics(t.sites, t.genotypes, t.samples.count())[1]


@query(
    "reset_multiallelic_formats",
    """SELECT vid, sample, CASE WHEN filter <> 'MULTIALLELIC' AND svtype <> 'CNV' THEN a1 END AS a1, CASE WHEN filter <> 'MULTIALLELIC' AND svtype <> 'CNV' THEN a2 END AS a2, CASE WHEN filter <> 'MULTIALLELIC' THEN gq END AS gq,
      CASE WHEN filter = 'MULTIALLELIC' THEN rd_cn END AS cn, CASE WHEN filter = 'MULTIALLELIC' THEN rd_gq END AS cnq FROM fx_genotypes JOIN fx_sites USING (vid)""",
)
def _(t):
    g = t.genotypes.join(t.sites.select("vid", "svtype", "filter"), "vid")
    m = F.col("filter") == "MULTIALLELIC"
    null_gt = m | (F.col("svtype") == "CNV")
    return g.select("vid", "sample", *[F.when(~null_gt, F.col(a)).alias(a) for a in ("a1", "a2")], F.when(~m, F.col("gq")).alias("gq"), F.when(m, F.col("rd_cn")).alias("cn"), F.when(m, F.col("rd_gq")).alias("cnq"))


@query("rescale_genotype_qualities", "SELECT vid, sample, CAST(floor(gq / 10) AS INT) AS gq, CAST(floor(pe_gq / 10) AS INT) AS pe_gq, CAST(floor(sr_gq / 10) AS INT) AS sr_gq, CAST(floor(rd_gq / 10) AS INT) AS rd_gq FROM fx_genotypes")
def _(t):
    return cu.rescale_qualities(t.genotypes).select("vid", "sample", "gq", "pe_gq", "sr_gq", "rd_gq")


@query("fix_ends", "SELECT vid, pos, CASE WHEN stop < pos THEN pos ELSE stop END AS stop, CASE WHEN stop < pos AND svtype = 'BND' THEN stop END AS end2 FROM fx_sites")
def _(t):
    return cu.fix_ends(t.sites).select("vid", "pos", "stop", "end2")


@query(
    "alleles_from_copy_state",
    """WITH x AS (SELECT vid, sample, CASE WHEN svtype = 'DEL' THEN least(rd_cn, 2) ELSE rd_cn END AS gt, svtype FROM fx_genotypes JOIN fx_sites USING (vid)), m AS (SELECT *, max(gt) OVER (PARTITION BY vid) AS mx, CASE WHEN svtype IN ('DEL', 'DUP') THEN gt + 2 ELSE gt END AS st FROM x),
      s AS (SELECT *, CAST(floor(st / 2) AS INT) AS lo, CAST(ceil(st / 2) AS INT) AS hi, svtype IN ('DEL', 'DUP') AS cnv FROM m)
      SELECT vid, sample, gt, CAST(CASE WHEN mx > 2 THEN CASE WHEN cnv AND lo = 1 THEN 0 ELSE lo END WHEN gt >= 2 THEN 1 ELSE 0 END AS INT) AS a1, CAST(CASE WHEN mx > 2 THEN CASE WHEN cnv AND hi = 1 THEN 0 ELSE hi END WHEN gt >= 1 THEN 1 ELSE 0 END AS INT) AS a2 FROM s""",
)
def _(t):
    g = t.genotypes.join(t.sites.select("vid", "svtype"), "vid").select("vid", "sample", F.when(F.col("svtype") == "DEL", F.least("rd_cn", F.lit(2))).otherwise(F.col("rd_cn")).alias("gt"))
    return cu.alleles_from_dose(g, t.sites)


@query("evidence_code_text", "SELECT vid, sample, concat_ws(',', CASE WHEN ev & 1 > 0 THEN 'RD' END, CASE WHEN ev & 2 > 0 THEN 'PE' END, CASE WHEN ev & 4 > 0 THEN 'SR' END) AS ev FROM fx_genotypes")
def _(t):
    return t.genotypes.select("vid", "sample", cu.evidence_text("ev").alias("ev"))


@query(
    "set_null_genotypes",
    """SELECT g.vid, g.sample, CASE WHEN gq < 10 THEN 0 ELSE a1 END AS a1, CASE WHEN gq < 10 THEN 0 ELSE a2 END AS a2, CASE WHEN gq < 10 THEN 0 ELSE gq END AS gq FROM fx_genotypes g""",
)
def _(t):
    return cu.set_null(t.genotypes, t.genotypes.where("gq < 10")).select("vid", "sample", "a1", "a2", "gq")


@query("redundant_multiallelic_sites")
def _(t):
    return cu.redundant_multiallelics(t.sites)


@query(
    "filter_and_info_cleanup",
    """SELECT vid, CASE WHEN svtype = 'INS' AND contains(alt, 'INS:ME') THEN 'MEI' ELSE svtype END AS svtype, CASE WHEN filter = 'UNRESOLVED' THEN 'UNRESOLVED' WHEN filter = 'PASS' THEN '.' ELSE filter END AS filter, filter = 'UNRESOLVED' AS unresolved, qual FROM fx_sites""",
)
def _(t):
    s = t.sites
    mei = (F.col("svtype") == "INS") & F.col("alt").contains("INS:ME")
    return s.select("vid", F.when(mei, "MEI").otherwise(F.col("svtype")).alias("svtype"), F.when(F.col("filter") == "PASS", ".").otherwise(F.col("filter")).alias("filter"), (F.col("filter") == "UNRESOLVED").alias("unresolved"), "qual")
