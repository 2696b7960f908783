"""Depth tests and coverage queries."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..functions.stats import norm_cdf_sql
from ..operators import coverage as cv
from ..operators import depth as dp
from ..operators.numbering import number_rows, shard_rows
from .registry import query

_EV = "SELECT concat('v', CAST(p_partkey AS STRING)) AS vid, CASE WHEN p_partkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END AS svtype, concat('chr', CAST(1 + p_partkey % 5 AS STRING)) AS chrom, (p_partkey * 9973) % 30000 AS start, (p_partkey * 9973) % 30000 + 400 * p_size AS stop FROM part"
_MED = "med AS (SELECT sample, median(cov) AS median_cov FROM fx_bincov GROUP BY sample)"
_SEL = f"""ev AS ({_EV}), bins AS (SELECT DISTINCT chrom, start, stop FROM fx_bincov),
  p AS (SELECT vid, ev.chrom, ev.start AS s, ev.stop AS e, b.start AS bs, b.stop AS be FROM ev JOIN bins b ON b.chrom = ev.chrom AND b.start < ev.stop AND ev.start < b.stop),
  p1 AS (SELECT *, coalesce(min(CASE WHEN bs >= s THEN bs END) OVER (PARTITION BY vid), min(bs) OVER (PARTITION BY vid)) AS a0, coalesce(max(CASE WHEN be <= e THEN be END) OVER (PARTITION BY vid), max(be) OVER (PARTITION BY vid)) AS e0 FROM p),
  p2 AS (SELECT *, bs >= a0 AND be <= e0 AS inn, count(*) FILTER (bs >= a0 AND be <= e0) OVER (PARTITION BY vid) AS n, count(*) FILTER (bs >= a0 AND be <= e0) OVER (PARTITION BY vid ORDER BY bs) - 1 AS i FROM p1),
  p3 AS (SELECT *, least(10, n) AS nb, CASE WHEN least(10, n) > 1 THEN floor((n / least(10, n) - floor(n / least(10, n))) * least(10, n) / 2 + 1e-9) ELSE 0 END AS rem FROM p2),
  p4 AS (SELECT *, CASE WHEN nb <= 1 THEN 1.0 ELSE CAST((n - 2 * rem) AS DOUBLE) / nb END AS c FROM p3 WHERE nb <= 1 OR (inn AND i BETWEEN rem AND n - 1 - rem)),
  p5 AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY bs) AS r, count(*) OVER (PARTITION BY vid) AS k FROM p4),
  gs AS (SELECT p5.*, CAST(g AS INT) AS grp FROM p5, (SELECT unnest(range(1, 200)) AS g) gg WHERE (c <= 1 AND g = r) OR (c > 1 AND g <= floor(k / c + 1e-9) AND r > floor((g - 1) * c + 1e-9) AND r <= floor((g - 1) * c + 1e-9) + floor(c + 1e-9))),
  sel AS (SELECT vid, chrom, bs AS start, grp, c AS compression, count(*) OVER (PARTITION BY vid, grp) AS n_rows FROM gs)"""
_MAT = f"""{_SEL}, {_MED}, grid AS (SELECT DISTINCT vid, grp, n_rows, compression, sample FROM sel, fx_samples),
  cs AS (SELECT vid, grp, sample, sum(greatest(cov, 1)) AS sm, count(*) AS h FROM sel JOIN fx_bincov b ON b.chrom = sel.chrom AND b.start = sel.start GROUP BY vid, grp, sample),
  mat AS (SELECT g.vid, g.sample, g.grp, CAST(coalesce(sm, 0) + n_rows - coalesce(h, 0) AS DOUBLE) / (median_cov * compression) AS depth FROM grid g LEFT JOIN cs ON cs.vid = g.vid AND cs.grp = g.grp AND cs.sample = g.sample JOIN med ON med.sample = g.sample),
  inn AS (SELECT m.vid, m.sample, grp, depth, c.sample IS NOT NULL AS treat FROM (SELECT *, max(grp) OVER (PARTITION BY vid) AS mx FROM mat) m LEFT JOIN fx_carriers c ON c.vid = m.vid AND c.sample = m.sample WHERE mx < 4 OR (grp > 1 AND grp < mx)),
  sd AS (SELECT vid, sample, treat, median(depth) AS depth FROM inn GROUP BY vid, sample, treat)"""


def _medians(t):
    return t.bincov.groupBy("sample").agg(F.percentile("cov", F.lit(0.5)).alias("median_cov"))


def _matrix(t):
    return dp.depth_matrix(t.sql(_EV), t.bincov, _medians(t), t.samples)


@query("depth_bin_selection", f"WITH {_SEL} SELECT vid, chrom, start, grp, round(compression, 6) AS compression, n_rows FROM sel")
def _(t):
    return dp.select_bins(t.sql(_EV), t.bincov).withColumn("compression", r6("compression"))


@query("depth_matrix", f"WITH {_MAT} SELECT vid, sample, grp, round(depth, 6) AS depth FROM mat")
def _(t):
    return _matrix(t).withColumn("depth", r6("depth"))


@query(
    "depth_separation_and_rank",
    f"""WITH {_MAT}, rk AS (SELECT *, rank() OVER (PARTITION BY vid ORDER BY depth) + (count(*) OVER (PARTITION BY vid, depth) - 1) / 2 AS r FROM sd),
      a AS (SELECT vid, median(CASE WHEN treat THEN depth END) AS t, median(CASE WHEN NOT treat THEN depth END) AS c, median(CASE WHEN treat THEN r END) AS rk, count(*) AS n FROM rk GROUP BY vid)
      SELECT a.vid, round(CASE WHEN svtype = 'DEL' THEN c - t ELSE t - c END, 6) AS separation, CASE WHEN svtype = 'DEL' THEN rk ELSE n - rk + 1 END AS rank FROM a JOIN ev USING (vid)""",
)
def _(t):
    d = dp.separation_and_rank(dp.sample_depths(dp.inner_bins(_matrix(t), t.carriers)), t.sql(_EV))
    return d.withColumn("separation", r6("separation"))


@query(
    "depth_one_sample_test",
    f"""WITH {_MAT}, w AS (SELECT s.vid, s.sample, {norm_cdf_sql("(CASE WHEN svtype = 'DEL' THEN 1 ELSE -1 END) * (depth - mu) / sg")} AS p FROM sd s JOIN (SELECT vid, avg(depth) AS mu, stddev_samp(depth) AS sg FROM sd WHERE NOT treat GROUP BY vid) c USING (vid) JOIN ev USING (vid) WHERE treat),
      b AS (SELECT s.vid, s.sample, {norm_cdf_sql("(CASE WHEN svtype = 'DEL' THEN 1 ELSE -1 END) * (depth - mu) / sg")} AS p FROM inn s JOIN (SELECT vid, grp, avg(depth) AS mu, stddev_samp(depth) AS sg FROM inn WHERE NOT treat GROUP BY vid, grp) c ON c.vid = s.vid AND c.grp = s.grp JOIN ev ON ev.vid = s.vid WHERE treat),
      q AS (SELECT vid, sample, list(p ORDER BY p DESC) AS l FROM b GROUP BY vid, sample)
      SELECT w.vid, w.sample, round(p, 5) AS p, round(CASE WHEN len(l) > 1 THEN l[2] ELSE l[1] END, 5) AS p_2nd FROM w JOIN q ON q.vid = w.vid AND q.sample = w.sample""",
)
def _(t):
    d = dp.one_sample_tests(dp.inner_bins(_matrix(t), t.carriers), t.sql(_EV))
    return d.withColumns({c: F.round(c, 5) for c in ("p", "p_2nd")})


@query(
    "depth_two_sample_test",
    f"""WITH {_MAT}, a AS (SELECT vid, count(*) AS n, count(*) FILTER (NOT treat) AS c, avg(depth) AS mu, var_pop(depth) AS v, sum(CASE WHEN NOT treat THEN depth END) AS s FROM sd GROUP BY vid),
      z AS (SELECT a.vid, (CASE WHEN svtype = 'DEL' THEN -1 ELSE 1 END) * (s - c * mu) / sqrt(c * (n - c) * v / (n - 1)) AS z FROM a JOIN ev USING (vid) WHERE c > 0 AND c < n),
      ab AS (SELECT vid, grp, count(*) AS n, count(*) FILTER (NOT treat) AS c, avg(depth) AS mu, var_pop(depth) AS v, sum(CASE WHEN NOT treat THEN depth END) AS s FROM inn GROUP BY vid, grp),
      zb AS (SELECT vid, grp, (CASE WHEN svtype = 'DEL' THEN -1 ELSE 1 END) * (s - c * mu) / sqrt(c * (n - c) * v / (n - 1)) AS z FROM ab JOIN ev USING (vid) WHERE c > 0 AND c < n),
      q AS (SELECT vid, list(p ORDER BY p DESC) AS l FROM (SELECT vid, {norm_cdf_sql('z')} AS p FROM zb) x GROUP BY vid)
      SELECT vid, round({norm_cdf_sql('z')}, 5) AS p, round(CASE WHEN len(l) > 1 THEN l[2] ELSE l[1] END, 5) AS p_2nd FROM z JOIN q USING (vid)""",
)
def _(t):
    d = dp.two_sample_tests(dp.inner_bins(_matrix(t), t.carriers), t.sql(_EV))
    return d.select("vid", F.round("p", 5).alias("p"), F.round("p_2nd", 5).alias("p_2nd"))


def _erf(a):
    return f"(CASE WHEN {a} <= 0 THEN 0.0 WHEN {a} > 6 THEN 1.0 ELSE list_sum(list_transform(range(0, 130), lambda n: exp(-({a}) * ({a}) + (2 * n + 1) * ln({a}) - lgamma(n + 1.5)))) END)"


def _tail(t, df, shift):
    """P(T > t) of the noncentral t distribution: the trapezoid rule over the chi density in the logarithm of its argument."""
    z = f"(({t}) * exp(j / 4.0 / sqrt({df})) - ({shift}))"
    up = f"(CASE WHEN {z} >= 0 THEN 0.5 - 0.5 * {_erf(f'{z} / sqrt(2)')} ELSE 0.5 + 0.5 * {_erf(f'-{z} / sqrt(2)')} END)"
    g = f"exp({df} * (j / 4.0 / sqrt({df}) - exp(j / 2.0 / sqrt({df})) / 2) + {df} / 2.0)"
    return f"(list_sum(list_transform(range(-160, 33), lambda j: CASE WHEN {g} > 1e-15 THEN {g} * {up} ELSE 0 END)) / list_sum(list_transform(range(-160, 33), lambda j: {g})))"


_FLIP = """nf AS (SELECT vid, count(DISTINCT sample) FILTER (treat) AS nt, count(DISTINCT sample) FILTER (NOT treat) AS nc FROM inn GROUP BY vid),
  e2 AS (SELECT ev.vid, CASE WHEN nt > nc AND nc > 0 THEN CASE svtype WHEN 'DEL' THEN 'DUP' ELSE 'DEL' END ELSE svtype END AS svtype, nt, nc FROM ev LEFT JOIN nf USING (vid)),
  i2 AS (SELECT inn.vid, sample, grp, depth, treat <> (nt > nc AND nc > 0) AS treat FROM inn JOIN nf USING (vid)), s2 AS (SELECT vid, sample, treat, median(depth) AS depth FROM i2 GROUP BY vid, sample, treat)"""
_SIGN = "(CASE WHEN svtype = 'DEL' THEN 1 ELSE -1 END)"


def _fisher(p):
    x = f"(-sum(ln(greatest({p}, 1e-300))))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, count(*)), lambda i: exp(-{x} + i * ln({x}) - lgamma(i + 1))))) END)"


@query(
    "depth_test",
    f"""WITH RECURSIVE {_MAT}, {_FLIP},
      w1 AS (SELECT s2.vid, sample, {norm_cdf_sql(f"{_SIGN} * (depth - mu) / sg")} AS p FROM s2 JOIN (SELECT vid, avg(depth) AS mu, stddev_samp(depth) AS sg FROM s2 WHERE NOT treat GROUP BY vid) c USING (vid) JOIN e2 USING (vid) WHERE treat),
      b1 AS (SELECT i2.vid, sample, {norm_cdf_sql(f"{_SIGN} * (depth - mu) / sg")} AS p FROM i2 JOIN (SELECT vid, grp, avg(depth) AS mu, stddev_samp(depth) AS sg FROM i2 WHERE NOT treat GROUP BY vid, grp) c ON c.vid = i2.vid AND c.grp = i2.grp JOIN e2 ON e2.vid = i2.vid WHERE treat),
      q1 AS (SELECT vid, sample, CASE WHEN len(l) > 1 THEN l[2] ELSE l[1] END AS q FROM (SELECT vid, sample, list(p ORDER BY p DESC) AS l FROM b1 GROUP BY vid, sample) x),
      f1 AS (SELECT vid, {_fisher('p')} AS p1, {_fisher('q')} AS q1 FROM w1 JOIN q1 USING (vid, sample) GROUP BY vid),
      a2 AS (SELECT vid, 0 AS grp, count(*) AS n, count(*) FILTER (NOT treat) AS c, avg(depth) AS mu, var_pop(depth) AS v, sum(CASE WHEN NOT treat THEN depth END) AS s FROM s2 GROUP BY vid UNION ALL SELECT vid, grp, count(*), count(*) FILTER (NOT treat), avg(depth), var_pop(depth), sum(CASE WHEN NOT treat THEN depth END) FROM i2 GROUP BY vid, grp),
      z2 AS (SELECT vid, grp, {norm_cdf_sql(f"(-{_SIGN} * (s - c * mu) / sqrt(c * (n - c) * v / (n - 1)))")} AS p FROM a2 JOIN e2 USING (vid) WHERE c > 0 AND c < n),
      f2 AS (SELECT vid, max(CASE WHEN grp = 0 THEN p END) AS p2, list(p ORDER BY p DESC) FILTER (grp > 0) AS l FROM z2 GROUP BY vid),
      pa AS (SELECT vid, count(*) FILTER (treat) AS nt, count(*) FILTER (NOT treat) AS nc, stddev_samp(CASE WHEN NOT treat THEN depth END) AS sg FROM s2 GROUP BY vid),
      dfs AS (SELECT DISTINCT (nt + nc - 2)::DOUBLE AS df FROM pa WHERE nt > 1 AND nc > 1),
      bi AS (SELECT df, 0 AS i, 0.0::DOUBLE AS lo, 8.0::DOUBLE AS hi FROM dfs UNION ALL SELECT df, i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {_tail('((lo + hi) / 2)', 'df', '0')} > 0.05 AS up FROM bi WHERE i < 45) x),
      tc AS (SELECT df, lo AS t FROM bi WHERE i = 45),
      pw AS (SELECT vid, {_tail('t', 'df', '0.5 / sg * sqrt(nt * nc / (nt + nc))')} AS power FROM pa JOIN tc ON tc.df = nt + nc - 2 WHERE nt > 1 AND nc > 1),
      rk AS (SELECT *, rank() OVER (PARTITION BY vid ORDER BY depth) + (count(*) OVER (PARTITION BY vid, depth) - 1) / 2 AS r FROM s2),
      sr AS (SELECT vid, median(CASE WHEN treat THEN depth END) AS tm, median(CASE WHEN NOT treat THEN depth END) AS cm, median(CASE WHEN treat THEN r END) AS rk, count(*) AS n FROM rk GROUP BY vid),
      al AS (SELECT e2.vid, CASE WHEN nt IS NULL THEN 'coverage_failure' WHEN nt = 0 THEN 'No_samples_for_analysis' WHEN nc = 0 THEN 'All_samples_called_CNV_no_analysis' ELSE 'ok' END AS status, svtype FROM e2)
      SELECT al.vid, status, CASE WHEN status = 'ok' THEN round(power, 5) END AS power, CASE WHEN status = 'ok' THEN round(CASE WHEN power > 0.8 THEN p2 ELSE p1 END, 5) END AS p, CASE WHEN status = 'ok' THEN round(CASE WHEN power > 0.8 THEN CASE WHEN len(l) > 1 THEN l[2] ELSE l[1] END ELSE q1 END, 5) END AS p_2nd,
        CASE WHEN status = 'ok' THEN CASE WHEN power > 0.8 THEN 'twoSampPerm' ELSE 'singleSampZ' END END AS test, CASE WHEN status = 'ok' THEN round(CASE WHEN svtype = 'DEL' THEN cm - tm ELSE tm - cm END, 6) END AS separation, CASE WHEN status = 'ok' THEN CASE WHEN svtype = 'DEL' THEN rk ELSE n - rk + 1 END END AS rank
      FROM al LEFT JOIN f1 USING (vid) LEFT JOIN f2 USING (vid) LEFT JOIN pw USING (vid) LEFT JOIN sr USING (vid)""",
)
def _(t):
    d = dp.depth_test(_matrix(t), t.carriers, t.sql(_EV))
    return d.withColumns({**{c: F.round(c, 5) for c in ("power", "p", "p_2nd")}, "separation": r6("separation")})


_TRAIN = f"""{_MAT}, st AS (SELECT CAST(greatest(ceil((depth - 0.25) / 0.5), 0) AS INT) AS copy_state, depth FROM sd WHERE depth > 0), a AS (SELECT copy_state, avg(depth) AS m, stddev_samp(depth) AS s FROM st GROUP BY copy_state),
  b AS (SELECT CAST(k AS INT) AS copy_state, coalesce(m, (k + 1) * 0.5) AS mean, s FROM (SELECT unnest(range(0, 5)) AS k) x LEFT JOIN a ON a.copy_state = k),
  c AS (SELECT copy_state, mean, last_value(s IGNORE NULLS) OVER (ORDER BY copy_state) AS sd FROM b),
  cut AS (SELECT *, CASE WHEN copy_state = 4 THEN 2.25 ELSE (lead(mean) OVER w / lead(sd) OVER w + mean / sd) / (1 / sd + 1 / lead(sd) OVER w) END AS cutoff FROM c WINDOW w AS (ORDER BY copy_state))"""


def _cuts(t):
    return dp.train_copy_state_cutoffs(dp.sample_depths(dp.inner_bins(_matrix(t), t.carriers)))


def _ph(m):
    return f"(-10 * log10(greatest({norm_cdf_sql(f'(-abs(depth - {m}) / s)')}, 1e-300)))"


@query("train_depth_cutoffs", f"WITH {_TRAIN} SELECT copy_state, round(mean, 6) AS mean, round(sd, 6) AS sd, round(cutoff, 6) AS cutoff FROM cut")
def _(t):
    return _cuts(t).withColumns({c: r6(c) for c in ("mean", "sd", "cutoff")})


@query(
    "depth_genotypes",
    f"""WITH {_TRAIN}, k AS (SELECT vid, sample, depth, CAST(coalesce((SELECT min(cut.copy_state) FROM cut WHERE sd.depth <= cut.cutoff), ceil((depth - 0.25) / 0.5)) AS INT) AS k FROM sd), s2 AS (SELECT sd AS s FROM cut WHERE copy_state = 2),
      m AS (SELECT k.*, s, coalesce(a.mean, k * 0.5) AS m0, coalesce(b.mean, (k + 1) * 0.5) AS m2, coalesce(c.mean, (CASE WHEN k = 0 THEN 1 ELSE k - 1 END) * 0.5) AS m1 FROM k, s2 LEFT JOIN cut a ON a.copy_state = k LEFT JOIN cut b ON b.copy_state = k + 1 LEFT JOIN cut c ON c.copy_state = CASE WHEN k = 0 THEN 1 ELSE k - 1 END),
      g AS (SELECT *, round_even(least({_ph('m1')}, {_ph('m2')}) - {_ph('m0')}, 0) AS g FROM m)
      SELECT vid, sample, round(depth, 6) AS depth, k AS copy_state, CAST(CASE WHEN g > 999 THEN 999 WHEN g < 0 THEN 1 ELSE g END AS INT) AS gq FROM g""",
)
def _(t):
    d = dp.sample_depths(dp.inner_bins(_matrix(t), t.carriers))
    return dp.genotype_depths(d, dp.train_copy_state_cutoffs(d)).withColumn("depth", r6("depth"))


@query("depth_variant_quality")
def _(t):
    d = dp.sample_depths(dp.inner_bins(_matrix(t), t.carriers))
    return dp.variant_depth_quality(dp.genotype_depths(d, dp.train_copy_state_cutoffs(d)), 0.25)


_ALN = "SELECT concat('chr', CAST(1 + l_suppkey % 5 AS STRING)) AS chrom, concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample, (l_partkey * 149 + l_linenumber) % 100000 AS start, (l_partkey * 149 + l_linenumber) % 100000 + 100 AS stop, (l_partkey * 149 + l_linenumber) % 100000 + 200 + CAST(l_quantity AS BIGINT) * 5 AS mate_stop, l_orderkey % 17 = 0 AS duplicate, l_orderkey % 19 = 0 AS secondary, l_orderkey % 23 <> 0 AS mapped, l_linestatus = 'O' AS proper FROM lineitem"


@query(
    "binned_coverage",
    f"WITH a AS ({_ALN}) SELECT chrom, b * 250 AS start, b * 250 + 250 AS stop, sample, count(*) AS cov FROM (SELECT chrom, sample, unnest(range(CAST(floor(start / 250) AS BIGINT), CAST(floor((stop - 1) / 250) AS BIGINT) + 1)) AS b FROM a WHERE NOT duplicate AND NOT secondary AND mapped) x GROUP BY chrom, b, sample",
)
def _(t):
    return cv.bin_alignments(t.sql(_ALN), 250)


@query(
    "binned_physical_coverage",
    f"""WITH a AS ({_ALN}), c AS (SELECT chrom, b * 250 AS start, b * 250 + 250 AS stop, sample, count(*) AS cov FROM (SELECT chrom, sample, unnest(range(CAST(floor(start / 250) AS BIGINT), CAST(floor((mate_stop - 1) / 250) AS BIGINT) + 1)) AS b FROM a WHERE NOT duplicate AND NOT secondary AND mapped AND proper AND mate_stop > start) x GROUP BY chrom, b, sample),
      k AS (SELECT DISTINCT c.chrom, c.start FROM c WHERE EXISTS (SELECT 1 FROM fx_regions r WHERE r.chrom = c.chrom AND r.start < c.stop AND c.start < r.stop AND least(r.stop, c.stop) - greatest(r.start, c.start) >= 0.05 * 250))
      SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chrom = c.chrom AND k.start = c.start)""",
)
def _(t):
    return cv.bin_alignments(t.sql(_ALN), 250, "physical", t.regions)


@query("bin_matrix_full_width", "WITH b AS (SELECT chrom, start, CASE WHEN start % 7000 = 0 THEN start + 400 ELSE stop END AS stop, sample, cov FROM fx_bincov) SELECT * FROM b WHERE stop - start = (SELECT mode(stop - start) FROM b)")
def _(t):
    return cv.build_matrix(t.bincov.withColumn("stop", F.when(F.col("start") % 7000 == 0, F.col("start") + 400).otherwise(F.col("stop"))))


@query("collapse_coverage", "SELECT chrom, CAST(floor(start / 5000) AS BIGINT) * 5000 AS start, CAST(floor(start / 5000) AS BIGINT) * 5000 + 5000 AS stop, sample, CAST(sum(cov) AS BIGINT) AS cov FROM fx_bincov GROUP BY 1, 2, 3, 4")
def _(t):
    return cv.collapse_bins(t.bincov, 5, 1000)


_MC = "bm AS (SELECT chrom, start, median(cov) AS bm FROM fx_bincov GROUP BY chrom, start), d AS (SELECT b.*, CASE WHEN floor(bm) <> 0 THEN cov END AS nz FROM fx_bincov b JOIN bm ON bm.chrom = b.chrom AND bm.start = b.start), m AS (SELECT sample, median(cov) AS a, median(nz) AS b FROM d GROUP BY sample)"


@query("median_coverage", f"WITH {_MC} SELECT m.sample, a AS med_with_zeros, b AS med_without_zeros, round(median(abs(cov - a)) * 1.4826, 6) AS mad_with_zeros, round(median(abs(nz - b)) * 1.4826, 6) AS mad_without_zeros FROM d JOIN m USING (sample) GROUP BY m.sample, a, b")
def _(t):
    return cv.median_coverage(t.bincov).withColumns({c: r6(c) for c in ("mad_with_zeros", "mad_without_zeros")})


@query("bin_median_coverage", "SELECT chrom, start, stop, median(cov) AS med_with_zeros, median(CASE WHEN cov > 0 THEN cov END) AS med_without_zeros FROM fx_bincov GROUP BY chrom, start, stop")
def _(t):
    return cv.bin_medians(t.bincov)


_CN = """am AS (SELECT sample, median(cov) AS m FROM fx_bincov WHERE chrom NOT IN ('chrX', 'chrY') AND cov > 0 GROUP BY sample), cn0 AS (SELECT chrom, start, stop, b.sample, 2 * cov / m AS cn FROM fx_bincov b JOIN am USING (sample)),
  z AS (SELECT chrom, start FROM cn0 GROUP BY chrom, start HAVING count(*) FILTER (cn <= 0.3) / count(*) <= 0.2 OR chrom IN ('chrX', 'chrY')), cn AS (SELECT cn0.* FROM cn0 JOIN z ON z.chrom = cn0.chrom AND z.start = cn0.start), cc AS (SELECT sample, chrom, median(cn) AS cn FROM cn GROUP BY sample, chrom)"""


def _cn(t):
    return cv.copy_numbers(t.bincov, min_samples=0.2, min_cov=0.3)


@query("contig_copy_numbers", f"WITH {_CN} SELECT sample, chrom, round(cn, 6) AS cn FROM cc")
def _(t):
    return cv.contig_copy_numbers(_cn(t)).withColumn("cn", r6("cn"))


@query("normalised_contig_copy_numbers", f"WITH {_CN}, m AS (SELECT chrom, median(cn) AS m FROM cc GROUP BY chrom) SELECT sample, cc.chrom, round(greatest(0.0, cn - (m - CASE WHEN cc.chrom IN ('chrX', 'chrY') THEN 1 ELSE 2 END)), 6) AS cn FROM cc JOIN m USING (chrom)")
def _(t):
    c = cv.contig_copy_numbers(_cn(t))
    pl = c.select("chrom").distinct().withColumn("ploidy", F.when(F.col("chrom").isin("chrX", "chrY"), 1).otherwise(2))
    return cv.normalise_contigs(c, pl).withColumn("cn", r6("cn"))


@query("dosage_bias_scores", f"WITH {_CN}, w AS (SELECT DISTINCT chrom, start, CAST(start / 1000 % 5 AS DOUBLE) - 2 AS weight FROM fx_bincov) SELECT sample, round(sum(abs(weight) * CASE WHEN weight > 0 THEN cn - 2 WHEN weight < 0 THEN 2 - cn END) / count(*), 6) AS score FROM cn JOIN w ON w.chrom = cn.chrom AND w.start = cn.start GROUP BY sample")
def _(t):
    w = t.sql("SELECT DISTINCT chrom, start, CAST(start / 1000 % 5 AS DOUBLE) - 2 AS weight FROM fx_bincov")
    return cv.dosage_scores(_cn(t), w).withColumn("score", r6("score"))


_SX = "SELECT CAST(n_nationkey % 5 AS INT) AS cn_x, CAST(floor(n_nationkey / 5) AS INT) AS cn_y, CASE WHEN n_nationkey % 5 = 2 AND n_nationkey < 5 THEN 'FEMALE' WHEN n_nationkey % 2 = 0 THEN 'MALE' ELSE 'TURNER' END AS sex FROM nation WHERE n_nationkey <> 7"


@query("sex_assignment", f"WITH {_CN}, l AS ({_SX}), x AS (SELECT sample, max(CASE WHEN chrom = 'chrX' THEN cn END) AS x, max(CASE WHEN chrom = 'chrY' THEN cn END) AS y FROM cc GROUP BY sample), r AS (SELECT sample, x, y, CAST(round_even(x, 0) AS INT) AS cn_x, CAST(round_even(y, 0) AS INT) AS cn_y FROM x), j AS (SELECT r.*, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN coalesce(sex, 'OTHER') END AS sex FROM r LEFT JOIN l ON l.cn_x = r.cn_x AND l.cn_y = r.cn_y), "
       f"q AS (SELECT stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM j WHERE sex = 'MALE'), zs AS (SELECT j.*, CASE WHEN cn_x > 0 THEN abs(x - cn_x) / (sx * cn_x) END AS zx, abs(y - cn_y) / (sy * greatest(cn_y, 1)) AS zy FROM j, q) SELECT sample, cn_x, cn_y, sex, round({norm_cdf_sql('(-zx)')}, 5) AS p_mosaic_x, round({norm_cdf_sql('(-zy)')}, 5) AS p_mosaic_y FROM zs")
def _(t):
    return cv.assign_sex(cv.contig_copy_numbers(_cn(t)), t.sql(_SX)).withColumns({c: F.round(c, 5) for c in ("p_mosaic_x", "p_mosaic_y")})


@query(
    "abnormal_contig_copy_numbers",
    f"""WITH {_CN}, s AS (SELECT chrom, avg(cn) AS mu, stddev_samp(cn) AS sg FROM cc GROUP BY chrom), p AS (SELECT sample, cc.chrom, cn, {norm_cdf_sql('(-abs((cn - mu) / sg))')} AS p FROM cc JOIN s USING (chrom)),
      r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY p, sample) AS r, count(*) OVER (PARTITION BY chrom) AS n FROM p)
      SELECT sample, chrom, round(cn, 6) AS cn, round(p, 5) AS p, round(least(1.0, min(p * n / r) OVER (PARTITION BY chrom ORDER BY r DESC)), 5) AS q FROM r""",
)
def _(t):
    d = cv.abnormal_contigs(cv.contig_copy_numbers(_cn(t)))
    return d.select("sample", "chrom", r6("cn").alias("cn"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query(
    "gc_correction",
    """WITH b AS (SELECT *, CAST((start / 1000 * 7) % 40 + 30 AS DOUBLE) / 100 AS gc FROM fx_bincov), d0 AS (SELECT *, CAST(round_even(gc * 100, 0) AS INT) AS g FROM b),
      t AS (SELECT sample, quantile_cont(CASE WHEN cov > 0 THEN cov END, 0.025) AS c0, quantile_cont(CASE WHEN cov > 0 THEN cov END, 0.975) AS c1, quantile_cont(g, 0.025) AS g0, quantile_cont(g, 0.975) AS g1 FROM d0 GROUP BY sample),
      d AS (SELECT d0.*, cov BETWEEN c0 AND c1 AS ins, g BETWEEN g0 AND g1 AS gin FROM d0 JOIN t USING (sample)),
      st AS (SELECT sample, g, stddev_samp(CASE WHEN ins THEN cov END) AS sg, count(*) FILTER (ins) AS nb, bool_or(gin) AS gi, quantile_cont(CASE WHEN cov > 0 THEN cov END, 0.25) AS q1, quantile_cont(CASE WHEN cov > 0 THEN cov END, 0.5) AS q2, quantile_cont(CASE WHEN cov > 0 THEN cov END, 0.75) AS q3 FROM d GROUP BY sample, g),
      sc AS (SELECT sample, sum(CASE WHEN gi THEN sg * nb END) / sum(CASE WHEN gi AND sg IS NOT NULL THEN nb END) AS ssd FROM st GROUP BY sample), mn AS (SELECT sample, avg(cov) AS sm FROM d WHERE ins AND gin GROUP BY sample),
      ce AS (SELECT d.sample, d.g, avg(cov) AS bm FROM d JOIN st ON st.sample = d.sample AND st.g = d.g WHERE cov BETWEEN q2 - 1.5 * (q3 - q1) AND q2 + 1.5 * (q3 - q1) GROUP BY d.sample, d.g)
      SELECT d.chrom, d.start, d.stop, d.sample, d.cov, round(CASE WHEN cov = 0 THEN 0.0 ELSE (cov - coalesce(bm, 0)) * CASE WHEN sg > 0 THEN ssd / sg ELSE 1 END + sm END, 5) AS corrected
      FROM d JOIN st ON st.sample = d.sample AND st.g = d.g LEFT JOIN ce ON ce.sample = d.sample AND ce.g = d.g JOIN sc ON sc.sample = d.sample JOIN mn ON mn.sample = d.sample""",
)
def _(t):
    b = t.bincov.withColumn("gc", ((F.col("start") / 1000 * 7) % 40 + 30).cast("double") / 100)
    return cv.gc_correct(b).withColumn("corrected", F.round("corrected", 5))


@query(
    "weighted_rolling_mean",
    """SELECT chrom, start, sample, cov, round((coalesce(0.1 * lag(cov, 2) OVER w, 0) + coalesce(0.2 * lag(cov) OVER w, 0) + cov + coalesce(0.2 * lead(cov) OVER w, 0) + coalesce(0.1 * lead(cov, 2) OVER w, 0))
      / (1.0 + CASE WHEN lag(cov, 2) OVER w IS NULL THEN 0 ELSE 0.1 END + CASE WHEN lag(cov) OVER w IS NULL THEN 0 ELSE 0.2 END + CASE WHEN lead(cov) OVER w IS NULL THEN 0 ELSE 0.2 END + CASE WHEN lead(cov, 2) OVER w IS NULL THEN 0 ELSE 0.1 END), 5) AS smoothed
      FROM fx_bincov WINDOW w AS (PARTITION BY sample, chrom ORDER BY start)""",
)
def _(t):
    return cv.rolling_mean(t.bincov).select("chrom", "start", "sample", "cov", F.round("smoothed", 5).alias("smoothed"))


@query(
    "train_dosage_model",
    f"""WITH {_CN}, g AS (SELECT sample, CASE WHEN pcr = 'PCRPLUS' THEN 'A' ELSE 'B' END AS grp FROM fx_samples),
      d AS (SELECT chrom, start, avg(CASE WHEN grp = 'A' THEN cn END) AS ma, avg(CASE WHEN grp = 'B' THEN cn END) AS mb, var_samp(CASE WHEN grp = 'A' THEN cn END) AS va, var_samp(CASE WHEN grp = 'B' THEN cn END) AS vb, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb FROM cn JOIN g USING (sample) GROUP BY chrom, start)
      SELECT chrom, start, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS separation, CASE WHEN abs(ma - mb) >= 0.1 AND ((ma >= 2 AND mb <= 2) OR (ma <= 2 AND mb >= 2)) THEN round((ma - mb) / sqrt(va / na + vb / nb), 5) END AS t,
        CASE WHEN abs(ma - mb) >= 0.1 AND ((ma >= 2 AND mb <= 2) OR (ma <= 2 AND mb >= 2)) THEN round(pow(va / na + vb / nb, 2) / (va / na * va / na / (na - 1) + vb / nb * vb / nb / (nb - 1)), 4) END AS df FROM d""",
)
def _(t):
    g = t.samples.select("sample", F.when(F.col("pcr") == "PCRPLUS", "A").otherwise("B").alias("grp"))
    d = cv.train_dosage_bins(_cn(t), g)
    return d.select("chrom", "start", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "separation")], F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))


@query("coverage_matrix_qc", "SELECT chrom, sample, CAST(min(cov) AS DOUBLE) AS q0, quantile_cont(cov, 0.25) AS q25, median(cov) AS q50, quantile_cont(cov, 0.75) AS q75, CAST(max(cov) AS DOUBLE) AS q100 FROM fx_bincov GROUP BY chrom, sample")
def _(t):
    return cv.matrix_qc(t.bincov)


@query("evidence_tail_qc", "WITH e AS (SELECT chrom, max(pos) AS e FROM fx_sr GROUP BY chrom) SELECT s.chrom, sample, count(*) AS n_rows FROM fx_sr s JOIN e USING (chrom) WHERE pos > e - 100000 GROUP BY s.chrom, sample")
def _(t):
    return cv.tail_rows(t.sr, 100000)


_SEG = "SELECT name, chrom, start, stop, sample, CAST(start % 5 AS INT) AS cn, CAST(stop % 100 AS INT) AS qs FROM fx_calls"
_PLO = "SELECT DISTINCT sample, chrom, CAST(CASE WHEN chrom = 'chr5' THEN 1 ELSE 2 END AS INT) AS ploidy FROM fx_calls"


@query("segments_to_calls", f"WITH s AS ({_SEG}), p AS ({_PLO}) SELECT s.*, CASE WHEN cn < ploidy THEN 'DEL' ELSE 'DUP' END AS svtype FROM s JOIN p ON p.sample = s.sample AND p.chrom = s.chrom WHERE cn <> ploidy AND qs >= 30")
def _(t):
    return cv.segments_to_calls(t.sql(_SEG), t.sql(_PLO), 30)


@query(
    "merge_caller_calls",
    """WITH c AS (SELECT *, CASE WHEN start % 2 = 0 THEN 'caller1' ELSE 'caller2' END AS caller FROM fx_calls), s AS (SELECT *, max(stop) OVER (PARTITION BY sample, svtype, chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sample, svtype, chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM s),
      m AS (SELECT sample, svtype, chrom, min(start) AS start, max(stop) AS stop, string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers FROM g GROUP BY sample, svtype, chrom, i)
      SELECT *, row_number() OVER (PARTITION BY svtype, chrom ORDER BY start, stop, sample) AS n FROM m""",
)
def _(t):
    return cv.merge_caller_calls(t.calls.withColumn("caller", F.when(F.col("start") % 2 == 0, "caller1").otherwise("caller2")))


@query("rename_variants", "SELECT name, concat('cohort_', svtype, '_', chrom, '_', CAST(row_number() OVER (PARTITION BY svtype, chrom ORDER BY start, stop, name) AS VARCHAR)) AS new_id FROM fx_calls")
def _(t):
    d = number_rows(t.calls.select("name", "svtype", "chrom", "start", "stop"), ["svtype", "chrom"], ["start", "stop", "name"])
    return d.select("name", F.concat_ws("_", F.lit("cohort"), "svtype", "chrom", F.col("n").cast("string")).alias("new_id"))


@query("shard_variants", "SELECT name, chrom, CAST(floor((row_number() OVER (PARTITION BY chrom ORDER BY start, stop, name) - 1) / 500) AS BIGINT) AS shard FROM fx_calls")
def _(t):
    return shard_rows(t.calls.select("name", "chrom", "start", "stop"), ["chrom"], ["start", "stop", "name"], 500).select("name", "chrom", "shard")


@query("coverage_sample_summary", "SELECT sample, count(*) AS n_bins, CAST(sum(cov) AS BIGINT) AS total, round(avg(cov), 6) AS mean, round(stddev_samp(cov), 6) AS sd, count(*) FILTER (cov < 20) AS n_low FROM fx_bincov GROUP BY sample")
def _(t):
    return t.bincov.groupBy("sample").agg(F.count("*").alias("n_bins"), F.sum("cov").alias("total"), r6(F.avg("cov")).alias("mean"), r6(F.stddev_samp("cov")).alias("sd"), F.count_if(F.col("cov") < 20).alias("n_low"))
