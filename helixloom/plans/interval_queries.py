"""Interval algebra queries."""

from pyspark.sql import functions as F

from ..functions.exprs import allowed_contig, r6
from ..operators import intervals as iv
from .registry import query


@query(
    "overlap_join_counts",
    """SELECT c.name, CAST(count(*) AS BIGINT) AS n_regions, CAST(sum(least(c.stop, r.stop) - greatest(c.start, r.start)) AS BIGINT) AS bases
       FROM fx_calls c JOIN fx_regions r ON c.chrom = r.chrom AND c.start < r.stop AND r.start < c.stop GROUP BY c.name""",
)
def _(t):
    p = iv.overlap_join(t.calls, t.regions, totals=True)
    return p.groupBy(F.col("name_a").alias("name")).agg(F.sum("n_b").alias("n_regions"), F.sum("bases_b").alias("bases"))


@query(
    "overlap_left_join",
    """SELECT c.name, CAST(count(r.start) AS BIGINT) AS n_regions FROM fx_calls c
       LEFT JOIN fx_regions r ON c.chrom = r.chrom AND c.start < r.stop AND r.start < c.stop GROUP BY c.name""",
)
def _(t):
    p = iv.overlap_left_join(t.calls, t.regions, key=["name"], totals=True)
    return p.groupBy(F.col("name_a").alias("name")).agg(F.sum("n_b").alias("n_regions"))


@query(
    "overlap_semi_join",
    """SELECT name, chrom, start, stop FROM fx_calls c WHERE EXISTS
       (SELECT 1 FROM fx_regions r WHERE c.chrom = r.chrom AND c.start < r.stop AND r.start < c.stop)""",
)
def _(t):
    return iv.overlap_semi(t.calls.select("name", "chrom", "start", "stop"), t.regions, ["name"])


@query(
    "overlap_anti_join",
    """SELECT name, chrom, start, stop FROM fx_calls c WHERE NOT EXISTS
       (SELECT 1 FROM fx_regions r WHERE c.chrom = r.chrom AND c.start < r.stop AND r.start < c.stop)""",
)
def _(t):
    return iv.overlap_semi(t.calls.select("name", "chrom", "start", "stop"), t.regions, ["name"], anti=True)


@query(
    "reciprocal_overlap_join",
    """SELECT a.name AS name_a, b.name AS name_b, least(a.stop, b.stop) - greatest(a.start, b.start) AS overlap
       FROM fx_calls a JOIN fx_calls b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.name < b.name
        AND a.start < b.stop AND b.start < a.stop
        AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (a.stop - a.start)
        AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (b.stop - b.start)""",
)
def _(t):
    c = t.calls.select("chrom", "svtype", "start", "stop", "name")
    p = iv.reciprocal_join(c, c, 0.8, condition=F.col("name_a") < F.col("name_b"))
    return p.select("name_a", "name_b", (F.least("stop_a", "stop_b") - F.greatest("start_a", "start_b")).alias("overlap"))


@query(
    "reciprocal_overlap_join_small_fraction",
    """SELECT c.name, r.start AS region, least(c.stop, r.stop) - greatest(c.start, r.start) AS overlap FROM fx_calls c JOIN fx_regions r ON c.chrom = r.chrom AND c.start < r.stop AND r.start < c.stop
        AND least(c.stop, r.stop) - greatest(c.start, r.start) >= 0.01 * (c.stop - c.start) AND least(c.stop, r.stop) - greatest(c.start, r.start) >= 0.01 * (r.stop - r.start)""",
)
def _(t):
    p = iv.reciprocal_join(t.calls.select("chrom", "start", "stop", "name"), t.regions, 0.01, by=["chrom"])
    return p.select(F.col("name_a").alias("name"), F.col("start_b").alias("region"), (F.least("stop_a", "stop_b") - F.greatest("start_a", "start_b")).alias("overlap"))


_MERGE = """WITH s AS (SELECT *, max(stop) OVER (PARTITION BY chrom, svtype ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_calls),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, svtype ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM s)
     SELECT chrom, svtype, min(start) AS start, max(stop) AS stop, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sample) AS BIGINT) AS n_samples FROM g GROUP BY chrom, svtype, island"""


@query("merge_intervals", _MERGE.format(gap=0))
def _(t):
    return iv.merge_intervals(t.calls, by=["chrom", "svtype"], aggs=[F.count("*").alias("n"), F.count_distinct("sample").alias("n_samples")])


@query("merge_intervals_with_gap", _MERGE.format(gap=200))
def _(t):
    return iv.merge_intervals(t.calls, by=["chrom", "svtype"], max_gap=200, aggs=[F.count("*").alias("n"), F.count_distinct("sample").alias("n_samples")])


_COV = """u AS (SELECT chrom, min(start) AS start, max(stop) AS stop FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_regions) s) g GROUP BY chrom, island),
     cov AS (SELECT c.name, c.chrom, c.start, c.stop, CAST(sum(CASE WHEN u.start IS NULL THEN 0 ELSE least(c.stop, u.stop) - greatest(c.start, u.start) END) AS BIGINT) AS covered
        FROM fx_calls c LEFT JOIN u ON c.chrom = u.chrom AND c.start < u.stop AND u.start < c.stop GROUP BY c.name, c.chrom, c.start, c.stop)"""


@query("coverage_fraction", f"WITH {_COV} SELECT name, covered, round(covered / (stop - start), 6) AS coverage FROM cov")
def _(t):
    d = iv.coverage_fraction(t.calls.select("name", "chrom", "start", "stop"), t.regions, ["name"])
    return d.select("name", "covered", r6("coverage").alias("coverage"))


@query("exclude_by_coverage", f"WITH {_COV} SELECT name, chrom, start, stop FROM cov WHERE covered / (stop - start) < 0.5")
def _(t):
    d = iv.coverage_fraction(t.calls.select("name", "chrom", "start", "stop"), t.regions, ["name"])
    return d.where("coverage < 0.5").select("name", "chrom", "start", "stop")


@query(
    "exclude_by_endpoint",
    """SELECT name, chrom, start, stop FROM fx_calls c WHERE NOT EXISTS (SELECT 1 FROM fx_regions r
       WHERE c.chrom = r.chrom AND ((c.start >= r.start AND c.start < r.stop) OR (c.stop >= r.start AND c.stop < r.stop)))""",
)
def _(t):
    c = t.calls.select("name", "chrom", "start", "stop")
    return iv.point_in_regions(iv.point_in_regions(c, t.regions, "start", anti=True), t.regions, "stop", anti=True)


@query(
    "endpoint_in_region_flag",
    """SELECT vid, EXISTS (SELECT 1 FROM fx_regions r WHERE r.chrom = s.chrom AND ((s.pos >= r.start AND s.pos < r.stop) OR (s.stop >= r.start AND s.stop < r.stop))) AS rmsk FROM fx_sites s""",
)
def _(t):
    s = t.sites.select("vid", "chrom", "pos", "stop")
    ends = s.select("vid", "chrom", F.explode(F.array("pos", "stop")).alias("p"))
    hit = iv.point_in_regions(ends, t.regions, "p").select("vid").distinct().withColumn("rmsk", F.lit(True))
    return s.join(hit, "vid", "left").select("vid", F.coalesce("rmsk", F.lit(False)).alias("rmsk"))


@query(
    "breakpoint_window_join",
    """SELECT a.vid AS vid_a, b.vid AS vid_b FROM fx_sites a JOIN fx_sites b ON a.chrom = b.chrom AND a.vid <> b.vid
        AND least(a.pos, a.stop) - 1 - 300 < greatest(b.pos, b.stop) AND least(b.pos, b.stop) - 1 < greatest(a.pos, a.stop) + 300
        AND NOT (a.svtype = 'DEL' AND b.svtype = 'DEL') AND NOT (a.svtype = 'DUP' AND b.svtype = 'DUP')""",
)
def _(t):
    s = t.sites.select("vid", "chrom", "svtype", (F.least("pos", "stop") - 1).alias("start"), F.greatest("pos", "stop").alias("stop"))
    cond = (F.col("vid_a") != F.col("vid_b")) & ~((F.col("svtype_a") == F.col("svtype_b")) & F.col("svtype_a").isin("DEL", "DUP"))
    return iv.overlap_join(s, s, pad=300, condition=cond).select("vid_a", "vid_b")


@query(
    "prefetch_regions",
    """WITH w AS (SELECT chrom, greatest(p - 250, 0) AS start, p + 250 AS stop FROM (SELECT chrom, pos AS p FROM fx_sites UNION ALL SELECT chr2, stop FROM fx_sites) x),
      s AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 16384 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM s)
      SELECT chrom, min(start) AS start, max(stop) AS stop FROM g GROUP BY chrom, island""",
)
def _(t):
    ends = t.sites.select("chrom", F.col("pos").alias("p")).unionByName(t.sites.select(F.col("chr2").alias("chrom"), F.col("stop").alias("p")))
    w = ends.select("chrom", F.greatest(F.col("p") - 250, F.lit(0)).alias("start"), (F.col("p") + 250).alias("stop"))
    return iv.merge_intervals(w, max_gap=16384)


@query("region_scan", "SELECT name, chrom, start, stop, svtype FROM fx_calls WHERE chrom = 'chr2' AND start >= 500000 AND start <= 900000")
def _(t):
    return t.calls.where("chrom = 'chr2' AND start BETWEEN 500000 AND 900000").select("name", "chrom", "start", "stop", "svtype")


@query(
    "batch_region_scan",
    """SELECT vid, chrom, pos FROM fx_sites s WHERE EXISTS (SELECT 1 FROM fx_regions r WHERE r.chrom = s.chrom AND s.pos >= r.start AND s.pos < r.stop)""",
)
def _(t):
    return iv.point_in_regions(t.sites.select("vid", "chrom", "pos"), t.regions, "pos")


@query("allowed_contigs", "SELECT vid, chrom FROM fx_sites WHERE chrom IN ('chr1','chr2','chr3','chr4','chr5','chrX','chrY') AND chr2 IN ('chr1','chr2','chr3','chr4','chr5','chrX','chrY')")
def _(t):
    return t.sites.where(allowed_contig("chrom") & allowed_contig("chr2")).select("vid", "chrom")


@query(
    "nearest_breakpoint",
    """WITH g AS (SELECT DISTINCT chrom, start AS gpos FROM fx_genes), p AS (SELECT DISTINCT chrom, start AS pos FROM fx_calls)
       SELECT p.chrom, p.pos, max(CASE WHEN gpos <= pos THEN gpos END) AS prev_pos, min(CASE WHEN gpos >= pos THEN gpos END) AS next_pos
       FROM p LEFT JOIN g ON p.chrom = g.chrom GROUP BY p.chrom, p.pos""",
)
def _(t):
    return iv.neighbours(t.calls.select("chrom", F.col("start").alias("pos")), t.genes.select("chrom", F.col("start").alias("pos")))
