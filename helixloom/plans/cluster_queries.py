"""Clustering and merging queries."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import cluster as cl
from .registry import query

# connected components by closure over a symmetric edge list e(a, b) on nodes n(node)
CC = """cc(node, label) AS (SELECT node, node FROM n UNION SELECT e.b, cc.label FROM cc JOIN e ON e.a = cc.node WHERE cc.label < e.b),
     lab AS (SELECT n.node, least(n.node, coalesce(min(cc.label), n.node)) AS label FROM n LEFT JOIN cc ON cc.node = n.node GROUP BY n.node)"""

_RO_EDGES = """n AS (SELECT name AS node FROM fx_calls),
     e AS (SELECT a.name AS a, b.name AS b FROM fx_calls a JOIN fx_calls b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.name <> b.name
        AND a.start < b.stop AND b.start < a.stop
        AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (a.stop - a.start)
        AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (b.stop - b.start))"""


@query("connected_components", f"WITH RECURSIVE {_RO_EDGES}, {CC} SELECT node AS name, label AS component FROM lab")
def _(t):
    c = t.calls.select("chrom", "svtype", "start", "stop", "name")
    return cl.reciprocal_components(c, 0.8).select("name", "component")


@query(
    "bed_clustering",
    f"""WITH RECURSIVE {_RO_EDGES}, {CC},
      r AS (SELECT c.*, label AS cluster FROM fx_calls c JOIN lab ON lab.node = c.name),
      per AS (SELECT cluster, chrom, svtype, sample, min(start) AS start, max(stop) AS stop, string_agg(name, ',' ORDER BY name) AS call_name FROM r GROUP BY cluster, chrom, svtype, sample),
      pre AS (SELECT cluster, sqrt(var_pop(start) + var_pop(stop)) AS pre_rmsstd FROM r GROUP BY cluster),
      post AS (SELECT cluster, count(*) AS vac, sqrt(var_pop(start) + var_pop(stop)) AS post_rmsstd, CAST(floor(median(start)) AS BIGINT) AS ms, CAST(floor(median(stop)) AS BIGINT) AS me FROM per GROUP BY cluster)
      SELECT per.cluster, chrom, svtype, sample, ms AS start, me AS stop, call_name, vac, round(vac / (SELECT count(DISTINCT sample) FROM fx_calls), 3) AS vaf,
        round(pre_rmsstd, 3) AS pre_rmsstd, round(post_rmsstd, 3) AS post_rmsstd FROM per JOIN pre USING (cluster) JOIN post USING (cluster)""",
)
def _(t):
    d = cl.bed_cluster(t.calls, 0.8, merge_coordinates=True)
    return d.withColumns({c: F.round(c, 3) for c in ("vaf", "pre_rmsstd", "post_rmsstd")})


_PT = "SELECT name, chrom AS chr_a, start AS pos_a, chrom AS chr_b, stop AS pos_b FROM fx_calls"


def _points(t):
    return t.calls.select("name", F.col("chrom").alias("chr_a"), F.col("start").alias("pos_a"), F.col("chrom").alias("chr_b"), F.col("stop").alias("pos_b"))


_BASE = "base AS (SELECT label, min_by(p.name, (pos_a, p.name)) AS cluster FROM p JOIN lab ON lab.node = p.name GROUP BY label)"


@query(
    "breakpoint_single_linkage",
    f"""WITH RECURSIVE p AS ({_PT}), n AS (SELECT name AS node FROM p),
      e AS (SELECT x.name AS a, y.name AS b FROM p x JOIN p y ON x.chr_a = y.chr_a AND x.chr_b = y.chr_b AND x.name <> y.name
        AND y.pos_a > x.pos_a - 300 AND y.pos_a < x.pos_a + 300 AND y.pos_b > x.pos_b - 300 AND y.pos_b < x.pos_b + 300),
      {CC}, {_BASE} SELECT p.name, cluster FROM p JOIN lab ON lab.node = p.name JOIN base USING (label)""",
)
def _(t):
    return cl.slink(_points(t), 300).select("name", "cluster")


@query(
    "candidate_batches",
    f"""WITH p AS ({_PT}), s AS (SELECT *, CASE WHEN lag(pos_a) OVER w IS NULL OR pos_a - lag(pos_a) OVER w >= 100 THEN pos_a END AS head FROM p WINDOW w AS (PARTITION BY chr_a ORDER BY pos_a, name))
      SELECT name, max(head) OVER (PARTITION BY chr_a ORDER BY pos_a, name ROWS UNBOUNDED PRECEDING) AS batch FROM s""",
)
def _(t):
    return cl.candidate_batches(_points(t), 100).select("name", "batch")


@query(
    "breakpoint_single_end_linkage",
    f"""WITH RECURSIVE p0 AS ({_PT}), s AS (SELECT *, CASE WHEN lag(pos_a) OVER w IS NULL OR pos_a - lag(pos_a) OVER w >= 40 THEN pos_a END AS head FROM p0 WINDOW w AS (PARTITION BY chr_a ORDER BY pos_a, name)),
      p AS (SELECT name, chr_a, pos_a, chr_b, pos_b, max(head) OVER (PARTITION BY chr_a ORDER BY pos_a, name ROWS UNBOUNDED PRECEDING) AS batch FROM s),
      n AS (SELECT name AS node FROM p),
      e AS (SELECT x.name AS a, y.name AS b FROM p x JOIN p y ON x.chr_a = y.chr_a AND x.batch = y.batch AND x.chr_b = y.chr_b AND x.name <> y.name
        AND (abs(x.pos_a - y.pos_a) < 40 OR abs(x.pos_b - y.pos_b) < 40)),
      {CC}, {_BASE} SELECT p.name, cluster FROM p JOIN lab ON lab.node = p.name JOIN base USING (label)""",
)
def _(t):
    return cl.slink_single_end(_points(t), 40).select("name", "cluster")


_VC = """v AS (SELECT name AS vid, chrom, chrom AS chr2, start AS pos, CASE WHEN svtype = 'INV' THEN start + 1 ELSE stop END AS stop,
        CASE WHEN svtype = 'INV' THEN 'INS' ELSE svtype END AS svtype, CASE svtype WHEN 'DUP' THEN '-+' ELSE '+-' END AS strands,
        CASE WHEN svtype = 'INV' AND stop - start < 1000 THEN -1 ELSE stop - start END AS svlen,
        CASE WHEN svtype <> 'INV' THEN concat('<', svtype, '>') WHEN start % 3 = 0 THEN '<INS:ME:ALU>' WHEN start % 3 = 1 THEN '<INS:ME:L1>' ELSE '<INS>' END AS alt,
        CASE start % 3 WHEN 0 THEN 'manta' WHEN 1 THEN 'wham' ELSE 'manta,melt' END AS algorithms, sample FROM fx_calls)"""
_VE = """n AS (SELECT vid AS node FROM v),
      d AS (SELECT x.vid AS a, y.vid AS b FROM v x JOIN v y ON x.chrom = y.chrom AND x.chr2 = y.chr2 AND x.svtype = y.svtype AND x.strands = y.strands
        AND (x.pos < y.pos OR (x.pos = y.pos AND x.vid < y.vid)) AND y.pos < x.pos + 300 AND abs(y.stop - x.stop) < 300
        AND (x.svtype <> 'INS' OR x.alt = y.alt OR x.alt = '<INS>')
        AND ((x.svtype = 'INS' AND (x.svlen = -1 OR y.svlen = -1)) OR (
          least(CASE WHEN x.svtype = 'INS' THEN x.pos + x.svlen ELSE x.stop END, CASE WHEN y.svtype = 'INS' THEN y.pos + y.svlen ELSE y.stop END) - greatest(x.pos, y.pos)
            >= 0.5 * greatest(CASE WHEN x.svtype = 'INS' THEN x.svlen ELSE x.stop - x.pos END, CASE WHEN y.svtype = 'INS' THEN y.svlen ELSE y.stop - y.pos END)))),
      e AS (SELECT a, b FROM d UNION SELECT b, a FROM d)"""
_VB = "base AS (SELECT label, min_by(v.vid, (pos, v.vid)) AS cluster FROM v JOIN lab ON lab.node = v.vid GROUP BY label), r AS (SELECT v.*, cluster FROM v JOIN lab ON lab.node = v.vid JOIN base USING (label))"


def _variants(t):
    return t.sql("WITH " + _VC + " SELECT * FROM v")


@query("variant_clustering", f"WITH RECURSIVE {_VC}, {_VE}, {CC}, {_VB} SELECT vid, cluster FROM r")
def _(t):
    return cl.cluster_sites(_variants(t), dist=300, frac=0.5).select("vid", "cluster")


@query(
    "merge_cluster_sites",
    f"""WITH RECURSIVE {_VC}, {_VE}, {CC}, {_VB},
      al AS (SELECT cluster, string_agg(a, ',' ORDER BY a) AS algorithms FROM (SELECT DISTINCT cluster, unnest(string_split(algorithms, ',')) AS a FROM r) x GROUP BY cluster),
      m AS (SELECT cluster, min_by(chrom, (pos, vid)) AS chrom, min_by(svtype, (pos, vid)) AS svtype, min_by(strands, (pos, vid)) AS strands,
        CAST(floor(median(pos)) AS BIGINT) AS pos, CAST(floor(median(stop)) AS BIGINT) AS stop,
        CAST(round_even(median(CASE WHEN svlen > -1 THEN svlen END), 0) AS BIGINT) AS il, string_agg(vid, ',' ORDER BY vid) AS members, count(*) AS n_members,
        min(pos) AS p0, max(pos) AS p1, min(stop) AS e0, max(stop) AS e1, sqrt(var_pop(pos) + var_pop(stop)) AS rmsstd FROM r GROUP BY cluster)
      SELECT cluster, chrom, svtype, strands, pos, stop, CASE WHEN svtype = 'INS' THEN coalesce(il, -1) ELSE stop - pos END AS svlen, algorithms, members, n_members,
        p0 - pos AS cipos_lo, p1 - pos AS cipos_hi, e0 - stop AS ciend_lo, e1 - stop AS ciend_hi, round(rmsstd, 3) AS rmsstd FROM m JOIN al USING (cluster)""",
)
def _(t):
    lab = cl.cluster_sites(_variants(t), dist=300, frac=0.5)
    return cl.merge_sites(lab).drop("chr2").withColumn("rmsstd", F.round("rmsstd", 3))


@query(
    "variant_clustering_shared_samples",
    """WITH RECURSIVE v AS (SELECT * FROM fx_sites), n AS (SELECT vid AS node FROM v),
      k AS (SELECT vid, count(*) AS nc FROM fx_carriers GROUP BY vid),
      d0 AS (SELECT x.vid AS a, y.vid AS b FROM v x JOIN v y ON x.chrom = y.chrom AND x.chr2 = y.chr2 AND x.svtype = y.svtype
        AND (x.pos < y.pos OR (x.pos = y.pos AND x.vid < y.vid)) AND y.pos < x.pos + 20000 AND abs(y.stop - x.stop) < 20000
        AND (x.svtype <> 'INS' OR x.alt = y.alt OR x.alt = '<INS>')
        AND (x.chrom <> x.chr2 OR (x.svtype = 'INS' AND (x.svlen = -1 OR y.svlen = -1)) OR (
          least(CASE WHEN x.svtype = 'INS' THEN x.pos + x.svlen ELSE x.stop END, CASE WHEN y.svtype = 'INS' THEN y.pos + y.svlen ELSE y.stop END) - greatest(x.pos, y.pos) > 0 AND
          least(CASE WHEN x.svtype = 'INS' THEN x.pos + x.svlen ELSE x.stop END, CASE WHEN y.svtype = 'INS' THEN y.pos + y.svlen ELSE y.stop END) - greatest(x.pos, y.pos)
            >= 0.1 * greatest(CASE WHEN x.svtype = 'INS' THEN x.svlen ELSE x.stop - x.pos END, CASE WHEN y.svtype = 'INS' THEN y.svlen ELSE y.stop - y.pos END)))),
      d AS (SELECT a, b FROM (SELECT a, b, count(*) AS nb FROM d0 JOIN fx_carriers p ON p.vid = a JOIN fx_carriers q ON q.vid = b AND q.sample = p.sample GROUP BY a, b) s
        JOIN k ka ON ka.vid = a JOIN k kb ON kb.vid = b WHERE nb >= 0.5 * ka.nc AND nb >= 0.5 * kb.nc),
      e AS (SELECT a, b FROM d UNION SELECT b, a FROM d), """ + CC + """,
      base AS (SELECT label, min_by(v.vid, (pos, v.vid)) AS cluster FROM v JOIN lab ON lab.node = v.vid GROUP BY label)
      SELECT vid, cluster FROM v JOIN lab ON lab.node = v.vid JOIN base USING (label)""",
)
def _(t):
    s = cl.cluster_sites(t.sites, dist=20000, frac=0.1, sample_overlap=0.5, carriers=t.carriers, match_strands=False)
    return s.select("vid", "cluster")


_GRP = "SELECT vid, concat(chrom, '_', CAST(CAST(floor(pos / 20000) AS BIGINT) AS STRING)) AS cluster FROM fx_sites"


@query(
    "merge_cluster_genotypes",
    f"""WITH c AS ({_GRP}) SELECT cluster, sample, CAST(0 AS INT) AS a1, CAST(max(CASE WHEN coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0 THEN 1 ELSE 0 END) AS INT) AS a2
      FROM fx_genotypes JOIN c USING (vid) GROUP BY cluster, sample""",
)
def _(t):
    return cl.merge_carrier_genotypes(t.sql(_GRP), t.genotypes)


@query(
    "best_genotype_per_cluster",
    f"""WITH c AS ({_GRP}), g AS (SELECT *, row_number() OVER (PARTITION BY cluster, sample ORDER BY CASE WHEN coalesce(a1, 0) > 0 OR coalesce(a2, 0) > 0 THEN 1 ELSE 0 END DESC, gq DESC, vid DESC) AS rn
      FROM fx_genotypes JOIN c USING (vid)) SELECT cluster, sample, a1, a2, gq, rd_cn, vid FROM g WHERE rn = 1""",
)
def _(t):
    g = t.genotypes.join(t.sql(_GRP), "vid").withColumn("_v", F.col("vid"))
    return cl.best_genotypes(g, ["cluster", "sample"], ["a1", "a2", "gq", "rd_cn", "vid"], order="_v")


@query(
    "merge_cluster_info",
    f"""WITH c AS ({_GRP}), f AS (SELECT c.cluster, s.* FROM fx_sites s JOIN c USING (vid)),
      ev AS (SELECT cluster, string_agg(x, ',' ORDER BY x) AS evidence FROM (SELECT DISTINCT cluster, unnest(string_split(evidence, ',')) AS x FROM f) y GROUP BY cluster)
      SELECT cluster, bool_or(filter = 'UNRESOLVED') AS unresolved, string_agg(DISTINCT filter, ',' ORDER BY filter) AS filters, max(qual) AS vargq, ev.evidence
      FROM f JOIN ev USING (cluster) GROUP BY cluster, ev.evidence""",
)
def _(t):
    f = t.sites.join(t.sql(_GRP), "vid")
    return f.groupBy("cluster").agg(
        F.bool_or(F.col("filter") == "UNRESOLVED").alias("unresolved"),
        F.array_join(F.array_sort(F.collect_set("filter")), ",").alias("filters"),
        F.max("qual").alias("vargq"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("evidence", ","))))), ",").alias("evidence"),
    )


@query(
    "defragment_calls",
    """WITH x AS (SELECT *, start - CAST(floor((stop - start) * 0.25) AS BIGINT) AS s, stop + CAST(floor((stop - start) * 0.25) AS BIGINT) AS e FROM fx_calls),
      y AS (SELECT *, max(e) OVER (PARTITION BY sample, svtype, chrom ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
      z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sample, svtype, chrom ORDER BY s, e, name ROWS UNBOUNDED PRECEDING) AS isl FROM y)
      SELECT sample, svtype, chrom, min(start) AS start, max(stop) AS stop, count(*) AS n_merged FROM z GROUP BY sample, svtype, chrom, isl""",
)
def _(t):
    return cl.defragment(t.calls)
