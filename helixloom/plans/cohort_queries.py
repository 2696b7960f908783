"""Components and clusters of coverage, copy states, mixtures, relationships, resolution driver, second genotyping, gene models."""

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import copy_states as cs
from ..operators import depth as dp
from ..operators import evidence as ev
from ..operators import factors as fa
from ..operators import mixture as mx
from ..operators import mosaic as mo
from ..operators import regenotype as rg
from ..operators import relatedness as rl
from ..operators import resolution as rn
from ..sources import gene_model as gm
from .cluster_queries import CC
from .coverage_queries import _EV, _MAT, _matrix
from .eigen import eigen_sql
from .evidence_queries import _DEL, _WIN, _balance
from .registry import query
from .resolve_queries import _NO, _ORD, _TYPES, _iv

# ---- coverage profiles -----------------------------------------------------------------------

_AUTO = "SELECT chrom, start, sample, CAST(cov AS DOUBLE) AS cov FROM fx_bincov WHERE chrom NOT IN ('chrX', 'chrY')"


def _profiles(t, k):
    d = t.sql(_AUTO)
    return fa.principal_components(d, k, row=["chrom", "start"], col="sample", value="cov", centre=True, scale=True)


@query(
    "coverage_components",
    f"""WITH d AS ({_AUTO}), nb AS (SELECT count(*) AS n FROM (SELECT DISTINCT chrom, start FROM d) x), st AS (SELECT sample, sum(cov) / n AS m, sqrt((sum(cov * cov) - sum(cov) * sum(cov) / n) / (n - 1)) AS sd FROM d, nb GROUP BY sample, n),
      pr AS (SELECT x.sample AS a, y.sample AS b, sum(x.cov * y.cov) AS s FROM d x JOIN d y ON y.chrom = x.chrom AND y.start = x.start GROUP BY 1, 2),
      g0 AS MATERIALIZED (SELECT p.sample AS a, q.sample AS b, (coalesce(s, 0) - n * p.m * q.m) / (p.sd * q.sd) AS v FROM st p CROSS JOIN st q LEFT JOIN pr ON pr.a = p.sample AND pr.b = q.sample, nb), {eigen_sql('g0', 4)}
      SELECT a AS sample, component, round(value, 4) AS value FROM eig""",
)
def _(t):
    return fa.with_signs(_profiles(t, 4), "sample").withColumn("value", F.round("value", 4))


@query("coverage_profile_clusters")
def _(t):
    return fa.cluster_profiles(_profiles(t, 4).vectors, smallest=6, largest=15, ideal=10)


# ---- copy states -----------------------------------------------------------------------------

_STATES = f"""{_MAT}, xs AS (SELECT vid, list(depth ORDER BY depth, sample) AS x, list(sample ORDER BY depth, sample) AS who FROM sd WHERE depth IS NOT NULL GROUP BY vid),
  sp AS (SELECT i / 10 AS sp FROM range(1, 11) r(i)),
  it AS (SELECT vid, sp, 0 AS i, x, who, list_transform(x, lambda v: least(greatest(ceil(round(v / sp - 0.5, 9)), 0), least(100, len(x) - 1))::INTEGER) AS l, false AS done FROM xs, sp
    UNION ALL SELECT vid, sp, i + 1, x, who, nl, nl = l FROM (
      SELECT *, list_transform(x, lambda v: ks[list_position(list_transform(cs, lambda c: round(abs(v - c), 9)), list_min(list_transform(cs, lambda c: round(abs(v - c), 9))))]) AS nl FROM (
        SELECT *, list_transform(ks, lambda k: list_avg(list_filter(x, lambda v, j: l[j] = k))) AS cs FROM (SELECT *, list_sort(list_distinct(l)) AS ks FROM it WHERE NOT done AND i < 100)))),
  fin AS (SELECT vid, sp, unnest(x) AS v, unnest(who) AS sample, unnest(l) AS k FROM (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY vid, sp ORDER BY i DESC) = 1)),
  pd AS (SELECT a.vid, a.sp, a.sample, a.k, b.k AS o, sum(abs(a.v - b.v)) AS s, count(*) AS n FROM fin a JOIN fin b ON b.vid = a.vid AND b.sp = a.sp GROUP BY ALL),
  sw AS (SELECT vid, sp, sample, max(CASE WHEN o = k THEN n END) AS own, max(CASE WHEN o = k THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN o <> k THEN s / n END) AS b FROM pd GROUP BY vid, sp, sample),
  wd AS (SELECT vid, sp, round(avg(CASE WHEN own > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS w FROM sw GROUP BY vid, sp),
  be AS (SELECT vid, sp, w FROM wd QUALIFY row_number() OVER (PARTITION BY vid ORDER BY w DESC, sp DESC) = 1)"""


@query(
    "copy_states",
    f"""WITH RECURSIVE {_STATES} SELECT f.vid, f.sample, round(v, 6) AS depth, k AS state, be.sp AS spacing, w AS separation, count(DISTINCT k) OVER (PARTITION BY f.vid)::INTEGER AS n_states FROM fin f JOIN be ON be.vid = f.vid AND be.sp = f.sp""",
)
def _(t):
    return cs.copy_states(dp.sample_depths(dp.inner_bins(_matrix(t), t.carriers))).withColumn("depth", r6("depth"))


# ---- allele-balance mixture ------------------------------------------------------------------

_LL = "ln(w[{j}]) - 0.5 * (ln(2 * pi() * s[{j}]) + pow({x} - m[{j}], 2) / s[{j}])"


def _lse(x):
    p = [f"({_LL.format(j=j, x=x)})" for j in (1, 2, 3)]
    top = f"greatest({', '.join(p)})"
    return f"({top} + ln({' + '.join(f'exp({q} - {top})' for q in p)}))"


_EM = f"""z AS (SELECT c.*, {_DEL} AS stat, k.sample IS NOT NULL AS cs FROM c LEFT JOIN fx_carriers k ON k.vid = c.vid AND k.sample = c.sample),
  e AS (SELECT vid, coalesce(list(stat ORDER BY stat) FILTER (cs AND stat IS NOT NULL), []) AS ca, coalesce(list(stat ORDER BY stat) FILTER (NOT cs AND stat IS NOT NULL), []) AS co, sum(inside) AS ns FROM z GROUP BY vid),
  s0 AS (SELECT *, CASE WHEN len(co) <= 10 OR list_max(co) - list_min(co) < 1e-4 THEN 'ROHregion' WHEN len(ca) = 0 THEN 'ROH' WHEN len(ca) > len(co) OR ns < 10 THEN 'Potential ROHregion or reference error' ELSE 'ok' END AS status FROM e),
  em AS (SELECT vid, co, 0 AS i, false AS done, NULL::DOUBLE AS ll, [1.0 / 3, 1.0 / 3, 1.0 / 3]::DOUBLE[] AS w, [co[len(co) // 6 + 1], co[len(co) // 2 + 1], co[len(co) * 5 // 6 + 1]] AS m, [list_var_pop(co) + 1e-6, list_var_pop(co) + 1e-6, list_var_pop(co) + 1e-6] AS s FROM s0 WHERE status = 'ok'
    UNION ALL SELECT vid, co, i + 1, coalesce(abs(nl - ll) < 1e-3, false), nl, list_transform(ms, lambda x: x / len(co)), nm, [{', '.join(f"list_sum(list_transform(co, lambda x, j: r[j][{j}] * pow(x - nm[{j}], 2))) / ms[{j}] + 1e-6" for j in (1, 2, 3))}] FROM (
      SELECT *, [{', '.join(f"list_sum(list_transform(co, lambda x, j: r[j][{j}] * x)) / ms[{j}]" for j in (1, 2, 3))}] AS nm FROM (
        SELECT *, [{', '.join(f"list_sum(list_transform(r, lambda q: q[{j}])) + 1e-12" for j in (1, 2, 3))}] AS ms FROM (
          SELECT *, list_avg(lp) AS nl, list_transform(co, lambda x, j: [{', '.join(f"exp({_LL.format(j=j, x='x')} - lp[j])" for j in (1, 2, 3))}]) AS r FROM (
            SELECT *, list_transform(co, lambda x: {_lse('x')}) AS lp FROM em WHERE NOT done AND i < 100))))),
  fi AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY vid ORDER BY i DESC) = 1)"""


@query(
    "allele_balance_deletion_likelihood",
    f"""WITH RECURSIVE {_WIN}, {_EM} SELECT s0.vid, round(CASE WHEN status = 'ok' THEN list_avg(list_transform(ca, lambda x: pow(10.0, -x))) END, 6) AS del_ratio, round(list_avg(list_transform(ca, lambda x: {_lse('x')})), 5) AS loglik, status FROM s0 LEFT JOIN fi ON fi.vid = s0.vid""",
)
def _(t):
    d = _balance(t, ev.balance_totals).withColumn("stat", ev.deletion_statistic()).join(t.carriers.select("vid", "sample", F.lit(True).alias("_c")), ["vid", "sample"], "left")
    d = mx.deletion_likelihood(d.withColumn("is_case", F.coalesce("_c", F.lit(False))))
    return d.select("vid", r6("del_ratio").alias("del_ratio"), F.round("loglik", 5).alias("loglik"), "status")


# ---- relationships ---------------------------------------------------------------------------

# pairs of customers with metrics around those of their relationship; every third pair's relationship is known
_KIN = """SELECT concat('C', CAST(o_custkey AS STRING)) AS a, concat('D', CAST(o_orderkey AS STRING)) AS b, CASE WHEN o_orderkey % 3 = 0 THEN rel END AS truth, rel,
    CASE rel WHEN 'parent_child' THEN 0.20 WHEN 'siblings' THEN 0.21 ELSE 0.12 END + e AS het_het, CASE rel WHEN 'parent_child' THEN 0.0005 WHEN 'siblings' THEN 0.012 ELSE 0.06 END + e / 10 AS ibs0,
    CASE rel WHEN 'parent_child' THEN 0.55 WHEN 'siblings' THEN 0.60 ELSE 0.30 END + e AS het_conc, CASE rel WHEN 'parent_child' THEN 0.001 WHEN 'siblings' THEN 0.04 ELSE 0.2 END + e / 10 AS hom_ibs0,
    CASE rel WHEN 'unrelated' THEN 0.0 ELSE 0.25 END + e / 5 AS kinship, CASE rel WHEN 'parent_child' THEN 0.98 WHEN 'siblings' THEN 0.5 ELSE 0.01 END + e / 5 AS ibd1_seg,
    CASE rel WHEN 'siblings' THEN 0.25 ELSE 0.0 END + e / 5 AS ibd2_seg, CASE rel WHEN 'unrelated' THEN 0.01 ELSE 0.5 END + e / 5 AS prop_ibd
  FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'parent_child' WHEN o_orderkey % 10 = 1 THEN 'siblings' ELSE 'unrelated' END AS rel, ((o_orderkey * 37 + o_custkey * 11) % 101 - 50) / 1000.0 AS e FROM orders) x"""


def _labelled(t):
    k = t.sql(_KIN).withColumns({m: F.col(m).cast("double") for m in rl.METRICS})
    truth = k.where("truth IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "truth").distinct()
    return rl.label_relationships(k, truth)


@query("relationship_labels", f"SELECT least(a, b) AS a, greatest(a, b) AS b, truth, rel AS inferred FROM ({_KIN}) k")
def _(t):
    return _labelled(t)


@query(
    "relationship_accuracy",
    f"""WITH k AS ({_KIN}), c AS (SELECT * FROM (VALUES ('unrelated', ['unrelated']), ('all_related', ['parent_child', 'siblings']), ('parent_child', ['parent_child']), ('siblings', ['siblings'])) v(relationship, l))
      SELECT relationship, 1.0::DOUBLE AS sensitivity, 0.0::DOUBLE AS false_discovery, count(*) FILTER (list_contains(l, truth)) AS n_known, count(*) FILTER (list_contains(l, truth)) AS n_kept, count(*) FILTER (truth IS NULL AND list_contains(l, rel)) AS n_new FROM k, c GROUP BY relationship""",
)
def _(t):
    return rl.relationship_accuracy(_labelled(t))


@query("known_relationships", """WITH p AS (SELECT sample, father, mother FROM fx_ped WHERE father IS NOT NULL AND mother IS NOT NULL), x AS (SELECT least(sample, father) AS a, greatest(sample, father) AS b, 'parent_child' AS t, 0 AS r FROM p UNION ALL SELECT least(sample, mother), greatest(sample, mother), 'parent_child', 0 FROM p
      UNION ALL SELECT least(father, mother), greatest(father, mother), 'unrelated', 2 FROM p UNION ALL SELECT a.sample, b.sample, 'siblings', 1 FROM p a JOIN p b ON a.father = b.father AND a.mother = b.mother AND a.sample < b.sample)
      SELECT a, b, min_by(t, r) AS truth FROM x GROUP BY a, b""")
def _(t):
    p = t.ped.where("father IS NOT NULL AND mother IS NOT NULL").select(F.col("sample").alias("proband"), "father", "mother")
    q = p.withColumnRenamed("proband", "b")
    sib = p.withColumnRenamed("proband", "a").join(q, ["father", "mother"]).where("a < b").select("a", "b")
    return rl.known_relationships(p, sib)


# ---- resolution driver -----------------------------------------------------------------------

_BK = "SELECT vid, cluster, chrom, chr2, svtype, strands, pos, stop, evidence, CASE WHEN svtype = 'BND' THEN -1 ELSE stop - pos END AS svlen, CASE WHEN svtype = 'INS' AND pos % 2 = 0 THEN '<INS:ME:ALU>' ELSE concat('<', svtype, '>') END AS alt FROM fx_breaks"
_ARMS = "SELECT DISTINCT chrom, 0 AS start, 1000000 AS stop, 'p' AS arm FROM fx_regions UNION ALL SELECT DISTINCT chrom, 1000000 AS start, 3000000 AS stop, 'q' AS arm FROM fx_regions"


def _typed(src, name):
    return _TYPES.replace("fx_breaks", src).replace("ct AS (", f"{name} AS (").replace("c AS (", f"{name}0 AS (", 1).replace("FROM c)", f"FROM {name}0)")


_SR = "coalesce(evidence = 'SR', false)"
_RESOLVE = f"""bk AS ({_BK}), arm AS ({_ARMS}),
  k0 AS (SELECT cluster, arg_min(vid, (pos, vid)) FILTER (svtype = 'INV' AND strands = '++') AS ff, arg_min(vid, (pos, vid)) FILTER (svtype = 'INV' AND strands = '--') AS rr, bool_and(svtype = 'INS') AS al FROM bk GROUP BY cluster),
  cln AS (SELECT bk.* REPLACE (CASE WHEN al THEN concat(cluster, '/', vid) ELSE cluster END AS cluster) FROM bk JOIN k0 USING (cluster) WHERE ff IS NULL OR rr IS NULL OR vid IN (ff, rr)),
  {_typed('cln', 'ta')},
  d AS (SELECT cln.*, cluster_type, cluster_type IN ('CANDIDATE_INVERSION', 'CANDIDATE_TRANSLOCATION', 'CANDIDATE_INSERTION', 'CANDIDATE_DISDUP', 'RESOLVED_INSERTION', 'SINGLE_INSERTION_STRIP_CNVS') AS ok FROM cln JOIN ta USING (cluster)),
  w AS (SELECT cluster, bool_and({_SR}) AS al FROM d WHERE NOT ok GROUP BY cluster),
  ag AS (SELECT d.* FROM d JOIN w USING (cluster) WHERE NOT ok AND (al OR NOT {_SR})), {_typed('ag', 'tb')},
  tc AS (SELECT * FROM tb WHERE cluster_type IN ('CANDIDATE_INVERSION', 'CANDIDATE_TRANSLOCATION', 'CANDIDATE_INSERTION', 'RESOLVED_INSERTION')),
  t AS (SELECT d.* EXCLUDE (cluster_type, ok), coalesce(tc.cluster_type, d.cluster_type) AS kind, ok OR tc.cluster IS NOT NULL AS res FROM d LEFT JOIN tc USING (cluster) LEFT JOIN w USING (cluster) WHERE tc.cluster IS NULL OR coalesce(al, true) OR NOT {_SR}),
  ip AS (SELECT cluster, min(chrom) AS chrom, max(CASE WHEN strands = '++' THEN pos END) AS fp, max(CASE WHEN strands = '++' THEN stop END) AS fe, max(CASE WHEN strands = '--' THEN pos END) AS rp, max(CASE WHEN strands = '--' THEN stop END) AS re, bool_and({_SR}) AS sr FROM t WHERE res AND kind = 'CANDIDATE_INVERSION' GROUP BY cluster),
  i1 AS (SELECT *, {_ORD} AS o FROM ip), i2 AS (SELECT *, CASE WHEN sr AND greatest(fe, re) - least(fp, rp) > 1000 THEN 'UNK' ELSE {_NO} END AS ct FROM i1),
  i3 AS (SELECT *, CASE WHEN ct = 'INV' THEN 'INV' WHEN ct IN ('UNK', 'COMPLEX_INS') THEN 'UNR' WHEN contains(ct, 'INS') THEN 'INS' ELSE 'CPX' END AS sv, ct = 'DUP3/INS5' AS i5 FROM i2),
  isl AS (SELECT chrom, min(start) AS s, max(stop) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY start, stop) AS g FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM fx_regions) a) b GROUP BY chrom, g),
  so AS (SELECT *, CASE WHEN i5 THEN re ELSE rp END AS s0, CASE WHEN i5 THEN fe ELSE fp END AS s1 FROM i3),
  me AS (SELECT cluster FROM so JOIN isl ON isl.chrom = so.chrom AND isl.s < s1 AND s0 < isl.e WHERE sv = 'INS' GROUP BY cluster, s0, s1 HAVING sum(least(isl.e, s1) - greatest(isl.s, s0)) >= 0.5 * (s1 - s0)),
  inv AS (SELECT cluster, chrom, CASE WHEN sv = 'INS' THEN CASE WHEN i5 THEN fp ELSE fe END ELSE least(fp, rp) END AS pos, CASE WHEN sv = 'INS' THEN CASE WHEN i5 THEN rp ELSE re END ELSE greatest(fe, re) END AS stop, chrom AS chr2, NULL::BIGINT AS end2, sv AS svtype,
      CASE WHEN cluster IN (SELECT cluster FROM me) THEN concat('MEI_', string_split(ct, '/')[2]) ELSE ct END AS cpx_type,
      CASE WHEN sv IN ('INV', 'CPX') THEN concat_ws(',', CASE WHEN starts_with(ct, 'del') THEN {_iv('DEL', 'fp', 'rp')} END, CASE WHEN starts_with(ct, 'dup') THEN {_iv('DUP', 'rp', 'fp')} END, {_iv('INV', 'rp', 'fe')}, CASE WHEN ends_with(ct, 'del') THEN {_iv('DEL', 'fe', 're')} END, CASE WHEN ends_with(ct, 'dup') THEN {_iv('DUP', 're', 'fe')} END) END AS cpx_intervals,
      CASE WHEN sv = 'INS' THEN {_iv('INV', 's0', 's1')} END AS source, CASE WHEN sv = 'INS' THEN abs(s1 - s0) ELSE abs(greatest(fe, re) - least(fp, rp)) END AS svlen, CASE WHEN sv = 'UNR' THEN 'SR_ONLY_LARGE_INVERSION' END AS why FROM so),
  pm AS (SELECT cluster, kind, arg_min(chrom, (strands, vid)) AS pc, arg_max(chrom, (strands, vid)) AS mc, arg_min(chr2, (strands, vid)) AS p2, arg_max(chr2, (strands, vid)) AS m2, arg_min(pos, (strands, vid)) AS pp, arg_max(pos, (strands, vid)) AS mp, arg_min(stop, (strands, vid)) AS pe, arg_max(stop, (strands, vid)) AS me, min(strands) AS st,
      bool_and(coalesce(list_contains(string_split(evidence, ','), 'PE'), false)) AS pr FROM t WHERE res AND ((kind = 'CANDIDATE_TRANSLOCATION' AND chrom <> chr2) OR (kind = 'CANDIDATE_INSERTION' AND chrom = chr2 AND svtype = 'BND') OR kind = 'CANDIDATE_DISDUP') GROUP BY cluster, kind),
  tl AS (SELECT *, mp > pp - 10 AS a1, pp > mp - 10 AS a2, me > pe - 10 AS b1, pe > me - 10 AS b2 FROM pm WHERE kind = 'CANDIDATE_TRANSLOCATION'),
  tk AS (SELECT tl.*, CASE WHEN pc <> mc OR p2 <> m2 THEN 'TLOC_MISMATCH_CHROM' WHEN st = '+-' THEN CASE WHEN a1 AND b2 THEN CASE WHEN pr THEN 'CTX_PP/QQ' ELSE 'CTX_UNR' END WHEN a1 AND b1 THEN 'CTX_INS_B2A' WHEN a2 AND b2 THEN 'CTX_INS_A2B' ELSE 'CTX_UNR' END
      ELSE CASE WHEN a1 AND b1 THEN CASE WHEN pr THEN 'CTX_PQ/QP' ELSE 'CTX_UNR' END WHEN a1 AND b2 THEN 'CTX_INV_INS_B2A' WHEN a2 AND b1 THEN 'CTX_INV_INS_A2B' ELSE 'CTX_UNR' END END AS k, x.arm AS xa, y.arm AS ya
    FROM tl LEFT JOIN arm x ON x.chrom = pc AND pp > x.start AND pp <= x.stop LEFT JOIN arm y ON y.chrom = p2 AND pe > y.start AND pe <= y.stop),
  tm AS (SELECT *, CASE WHEN k IN ('CTX_PP/QQ', 'CTX_PQ/QP') THEN CASE WHEN pp = mp AND pe = me THEN concat(k, '_DUPLICATE_COORDS') WHEN coalesce(CASE WHEN k = 'CTX_PP/QQ' THEN xa = ya ELSE xa <> ya END, false) THEN k ELSE concat(k, '_MISMATCH') END ELSE k END AS ct FROM tk),
  tn AS (SELECT *, CASE WHEN contains(ct, 'INS') THEN 'INS' WHEN ct IN ('CTX_PP/QQ', 'CTX_PQ/QP') THEN 'CTX' ELSE 'UNR' END AS sv, CASE k WHEN 'CTX_INS_B2A' THEN [pp, mp, pe, me] WHEN 'CTX_INV_INS_B2A' THEN [pp, mp, me, pe] WHEN 'CTX_INS_A2B' THEN [me, pe, mp, pp] WHEN 'CTX_INV_INS_A2B' THEN [pe, me, mp, pp] END AS q, ends_with(k, 'B2A') AS into_a FROM tm),
  tr AS (SELECT cluster, CASE WHEN sv = 'INS' AND NOT into_a THEN p2 ELSE pc END AS chrom, CASE WHEN sv = 'INS' THEN q[1] ELSE pp END AS pos, CASE WHEN sv = 'INS' THEN q[2] ELSE pe END AS stop, CASE WHEN sv = 'INS' AND NOT into_a THEN pc ELSE p2 END AS chr2, CASE WHEN sv = 'INS' THEN q[2] ELSE pe END AS end2, sv AS svtype, ct AS cpx_type, NULL AS cpx_intervals,
      CASE WHEN sv = 'INS' THEN concat(CASE WHEN contains(k, 'INV') THEN 'INV' ELSE 'INS' END, '_', CASE WHEN into_a THEN p2 ELSE pc END, ':', q[3], '-', q[4]) END AS source, CASE WHEN sv = 'INS' THEN abs(q[4] - q[3]) ELSE -1 END AS svlen, NULL AS why FROM tn),
  ik AS (SELECT *, CASE WHEN mp > pp - 50 AND me > pe - 50 THEN 'INS_B2A' WHEN pp > mp - 50 AND pe > me - 50 THEN 'INS_A2B' ELSE 'INS_UNCLASSIFIED' END AS k FROM pm WHERE kind <> 'CANDIDATE_TRANSLOCATION'),
  il AS (SELECT *, CASE k WHEN 'INS_B2A' THEN [pp, mp, pe, me] WHEN 'INS_A2B' THEN [me, pe, mp, pp] END AS q FROM ik),
  ins AS (SELECT cluster, pc AS chrom, q[1] AS pos, q[2] AS stop, pc AS chr2, NULL::BIGINT AS end2, CASE WHEN q IS NULL THEN 'UNR' ELSE 'INS' END AS svtype, k AS cpx_type, NULL AS cpx_intervals, CASE WHEN q IS NOT NULL THEN concat('INS_', pc, ':', q[3], '-', q[4]) END AS source, abs(q[4] - q[3]) AS svlen, NULL AS why FROM il),
  rk AS (SELECT *, count(*) FILTER (svtype IN ('DEL', 'DUP')) OVER (PARTITION BY cluster) AS nc, row_number() OVER (PARTITION BY cluster, svtype ORDER BY pos, vid) AS rn FROM t WHERE res AND kind IN ('RESOLVED_INSERTION', 'SINGLE_INSERTION_STRIP_CNVS')),
  rs AS (SELECT *, nc = 1 AND max(CASE WHEN svtype = 'DUP' THEN 1 ELSE 0 END) OVER (PARTITION BY cluster) = 1 AS dup FROM rk),
  rp_ AS (SELECT cluster, chrom, pos, stop, chr2, NULL::BIGINT AS end2, svtype, CASE WHEN NOT dup AND kind = 'RESOLVED_INSERTION' THEN translate(alt, '<>', '') END AS cpx_type, NULL AS cpx_intervals, NULL AS source, svlen, NULL AS why, dup OR kind = 'RESOLVED_INSERTION' OR nc = 0 AS whole FROM rs WHERE rn = 1 AND svtype = CASE WHEN dup THEN 'DUP' ELSE 'INS' END),
  fo AS (SELECT * FROM inv UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM ins UNION ALL SELECT * EXCLUDE (whole) FROM rp_ WHERE whole),
  mem AS (SELECT cluster, string_agg(vid, ',' ORDER BY vid) AS members FROM t GROUP BY cluster),
  un AS (SELECT t.*, CASE WHEN res THEN fo.why ELSE kind END AS why, CASE WHEN res AND fo.why IS NOT NULL THEN 'BND' ELSE t.svtype END AS sv FROM t LEFT JOIN fo ON fo.cluster = t.cluster AND fo.svtype = 'UNR' WHERE NOT res OR fo.cluster IS NOT NULL),
  sp AS (SELECT t.*, string_agg(CASE WHEN t.svtype IN ('DEL', 'DUP') AND NOT coalesce(list_contains(string_split(evidence, ','), 'RD'), false) THEN vid END, ',' ) OVER (PARTITION BY t.cluster) AS gone FROM t JOIN rp_ ON rp_.cluster = t.cluster AND NOT whole),
  sg AS (SELECT cluster, string_agg(vid, ',' ORDER BY vid) AS gone FROM sp WHERE svtype IN ('DEL', 'DUP') AND NOT coalesce(list_contains(string_split(evidence, ','), 'RD'), false) GROUP BY cluster)
  SELECT concat('CPX_', cluster) AS event, concat('CPX_', cluster) AS vid, chrom, pos, stop, chr2, end2, svtype, cpx_type, cpx_intervals, source, svlen::BIGINT AS svlen, why AS unresolved_type, members FROM fo JOIN mem USING (cluster) WHERE svtype <> 'UNR'
  UNION ALL SELECT concat('UNRESOLVED_', cluster), vid, chrom, pos, stop, chr2, NULL, sv, NULL, NULL, NULL, svlen, coalesce(why, CASE WHEN sv = 'BND' THEN 'SINGLE_ENDER' END), vid FROM un
  UNION ALL SELECT concat('SPLIT_', cluster), vid, chrom, pos, stop, chr2, NULL, svtype, NULL, NULL, NULL, svlen, NULL, CASE WHEN svtype = 'INS' THEN concat_ws(',', vid, sg.gone) ELSE vid END FROM sp LEFT JOIN sg USING (cluster) WHERE svtype = 'INS' OR (svtype IN ('DEL', 'DUP') AND coalesce(list_contains(string_split(evidence, ','), 'RD'), false))
  UNION ALL SELECT NULL, vid, chrom, pos, stop, chr2, NULL, svtype, NULL, NULL, NULL, svlen, CASE WHEN svtype = 'BND' THEN 'SINGLE_ENDER' END, vid FROM bk WHERE vid NOT IN (SELECT vid FROM t)"""


@query("resolve_clusters", f"WITH {_RESOLVE}")
def _(t):
    return rn.resolve_clusters(t.sql(_BK), t.sql(_ARMS), t.regions)


# ---- second genotyping -----------------------------------------------------------------------

_RAW = """SELECT DISTINCT concat('B', CAST(l_suppkey % 2 AS STRING), '_', CAST(l_partkey AS STRING)) AS vid, concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample, concat('chr', CAST(1 + l_partkey % 5 AS STRING)) AS chrom,
    (l_partkey * 1571) % 300000 AS start, (l_partkey * 1571) % 300000 + 8000 + (l_partkey % 50) * 400 AS stop, CASE WHEN l_partkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END AS svtype FROM lineitem"""
_MERGED = "SELECT min(vid) OVER (PARTITION BY chrom, start, stop, svtype) AS vid, sample, chrom, start, stop, svtype FROM raw"
_GENO = "SELECT vid, sample, chrom, start, stop, svtype FROM raw WHERE substr(vid, 1, 2) = 'B0' AND (start + length(sample)) % 3 <> 0 UNION ALL SELECT DISTINCT vid, 'S99' AS sample, chrom, start, stop, svtype FROM raw WHERE substr(vid, 1, 2) = 'B0' AND start % 4 = 0"
_MEDS = "SELECT vid, sample, CASE WHEN start % 17 = 0 THEN NULL ELSE 0.7 + CAST(start % 100 AS DOUBLE) / 100 END AS depth FROM raw"


def _lineage_sql():
    return f"""raw AS ({_RAW}), mg AS (SELECT DISTINCT * FROM ({_MERGED}) m), pl AS (SELECT DISTINCT vid AS node, chrom, start, stop, svtype FROM mg), n AS (SELECT node FROM pl),
      e AS (SELECT a.node AS a, b.node AS b FROM pl a JOIN pl b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.node <> b.node AND a.start < b.stop AND b.start < a.stop AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (a.stop - a.start) AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (b.stop - b.start)),
      {CC}, lin AS (SELECT DISTINCT raw.vid, min(raw.vid) OVER (PARTITION BY raw.chrom, raw.start, raw.stop, raw.svtype) AS site, label AS cluster, raw.chrom, raw.start, raw.stop, raw.svtype FROM raw JOIN pl ON pl.chrom = raw.chrom AND pl.start = raw.start AND pl.stop = raw.stop AND pl.svtype = raw.svtype JOIN lab ON lab.node = pl.node)"""


def _raw_tables(t):
    raw = t.sql(_RAW)
    on = lambda q: t.sql(q.replace("FROM raw", f"FROM ({_RAW}) raw"))
    return raw, rg.site_lineage(raw, on(_MERGED).distinct()), on(_GENO), on(_MEDS)


@query("regenotype_lineage", f"WITH RECURSIVE {_lineage_sql()} SELECT * FROM lin")
def _(t):
    return _raw_tables(t)[1]


@query("regenotype_cluster_samples", f"WITH RECURSIVE {_lineage_sql()} SELECT cluster, count(DISTINCT sample) AS n_samples, count(DISTINCT vid) AS n_ids FROM raw JOIN lin USING (vid) GROUP BY cluster")
def _(t):
    raw, lin, _, _ = _raw_tables(t)
    return rg.cluster_samples(raw, lin)


_TODO = f"""{_lineage_sql()}, g AS ({_GENO}), b0 AS (SELECT * FROM raw WHERE substr(vid, 1, 2) = 'B0'), cnt AS (SELECT cluster, count(DISTINCT sample) AS n_samples FROM raw JOIN lin USING (vid) GROUP BY cluster),
  df AS (SELECT DISTINCT g.vid FROM g WHERE stop - start > 10000 AND (EXISTS (SELECT 1 FROM b0 WHERE b0.chrom = g.chrom AND b0.start = g.start AND b0.stop = g.stop AND b0.svtype = g.svtype AND b0.sample NOT IN (SELECT sample FROM g h WHERE h.vid = g.vid)) OR g.sample NOT IN (SELECT sample FROM b0 WHERE b0.vid = g.vid))),
  md AS (SELECT vid, median(depth) AS median FROM ({_MEDS}) m GROUP BY vid HAVING count(*) = count(depth)),
  todo AS (SELECT df.vid, chrom, start, stop, svtype, cluster, n_samples, median FROM df JOIN lin USING (vid) JOIN cnt USING (cluster) JOIN md USING (vid) WHERE (n_samples / 40 < 0.8 OR n_samples <= 3) AND ((median > 0.85 AND median < 0.97) OR (median > 1.03 AND median < 1.65)))"""


def _todo(t):
    raw, lin, geno, meds = _raw_tables(t)
    return rg.sites_to_regenotype(raw.where("substr(vid, 1, 2) = 'B0'"), geno, lin, meds, t.samples.count(), max_frequency=0.8, cohort=raw)


@query("sites_to_regenotype", f"WITH RECURSIVE {_TODO} SELECT * FROM todo")
def _(t):
    return _todo(t)


@query("replace_regenotyped_records", f"""WITH RECURSIVE {_TODO} SELECT vid, sample, chrom, start, stop, svtype, 'old' AS origin FROM g WHERE vid NOT IN (SELECT vid FROM todo)
      UNION ALL SELECT vid, sample, chrom, start, stop, svtype, 'again' FROM raw WHERE start % 5 <> 0 AND vid IN (SELECT vid FROM todo)""")
def _(t):
    raw, _, geno, _ = _raw_tables(t)
    return rg.replace_records(geno.withColumn("origin", F.lit("old")), raw.where("start % 5 <> 0").withColumn("origin", F.lit("again")), _todo(t))


# ---- gene model files ------------------------------------------------------------------------

_TXS = """SELECT concat('T', CAST(p_partkey AS STRING)) AS tx, concat('G', CAST((p_partkey * 7) % 97 AS STRING)) AS gene, concat('chr', CAST(1 + ((p_partkey * 7) % 97) % 5 AS STRING)) AS chrom, 1000 + (p_partkey * 39877) % 100000 AS s, 1000 + (p_partkey * 39877) % 100000 + p_size * 30 AS e,
    CASE WHEN p_partkey % 4 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS kind, CASE WHEN (p_partkey * 7) % 97 % 10 = 9 THEN 'pseudogene' ELSE 'protein_coding' END AS gkind, p_partkey % 5 = 0 AS ccds, p_size * 10 AS tl, p_size * 20 + p_partkey % 11 AS xl,
    CASE WHEN p_partkey % 3 = 0 THEN 'ensembl_havana_transcript' WHEN p_partkey % 3 = 1 THEN 'proj_ensembl_havana_transcript' ELSE 'havana' END AS src, p_partkey AS k, p_size AS z FROM part"""
_ATTR = "concat('gene_id \"', gene, '\"; transcript_id \"', tx, '\"; gene_type \"', gkind, '\"; transcript_type \"', kind, '\"; level 2;', CASE WHEN ccds THEN ' tag \"basic\"; tag \"CCDS\";' ELSE '' END)"
_TAB = "chr(9)"


def _line(feature, s, e):
    return f"concat_ws({_TAB}, chrom, 'model', '{feature}', CAST({s} + 1 AS STRING), CAST({e} AS STRING), '.', CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END, '.', {_ATTR})"


_GTF = f"""SELECT '##format: gtf' AS value UNION ALL SELECT {_line('transcript', 's', 'e')} FROM ({_TXS}) a UNION ALL SELECT {_line('exon', 's', 's + 400')} FROM ({_TXS}) b WHERE k % 2 = 0 UNION ALL SELECT {_line('exon', 's + 500', 's + 900')} FROM ({_TXS}) c WHERE k % 2 = 0
  UNION ALL SELECT {_line('UTR', 's + 100', 's + 100 + z * 10')} FROM ({_TXS}) d WHERE k % 3 = 0"""


def _gtf(t):
    return gm.parse_gtf(t.sql(_GTF))


@query("gene_model_rows", f"""SELECT tx AS transcript, gene, chrom, s AS start, e AS stop, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN ccds THEN 'basic,CCDS' ELSE '' END AS tags FROM ({_TXS}) x""")
def _(t):
    back = gm.parse_gtf(gm.format_gtf(_gtf(t)))  # through lines twice
    return back.where("feature = 'transcript'").select(F.col("attributes")["transcript_id"].alias("transcript"), F.col("attributes")["gene_id"].alias("gene"), "chrom", "start", "stop", "strand", F.array_join("tags", ",").alias("tags"))


def _canonical(t):
    lengths = t.sql(f"SELECT tx AS transcript, tl AS translation_len, xl AS tx_len, src AS source FROM ({_TXS}) x")
    return gm.choose_canonical(gm.transcripts(_gtf(t), lengths))


_CANON = f"""cn AS (SELECT * FROM ({_TXS}) x WHERE gkind = 'protein_coding' QUALIFY row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN kind <> 'protein_coding' THEN 4 WHEN ccds THEN 0 WHEN src = 'ensembl_havana_transcript' THEN 1 WHEN src = 'proj_ensembl_havana_transcript' THEN 2 ELSE 3 END, CASE WHEN kind = 'protein_coding' THEN tl ELSE e - s END DESC, xl DESC, tx) = 1)"""


@query("canonical_transcripts_of_gene_model", f"WITH {_CANON} SELECT gene, tx AS transcript, kind, e - s AS seq_len FROM cn")
def _(t):
    return _canonical(t).select("gene", "transcript", "kind", "seq_len")


@query("canonical_gene_model", f"WITH {_CANON}, r AS (SELECT tx, 'transcript' AS feature, s AS start, e AS stop FROM cn UNION ALL SELECT tx, 'exon', s, s + 400 FROM cn WHERE k % 2 = 0 UNION ALL SELECT tx, 'exon', s + 500, s + 900 FROM cn WHERE k % 2 = 0 UNION ALL SELECT tx, 'UTR', s + 100, s + 100 + z * 10 FROM cn WHERE k % 3 = 0) SELECT tx AS transcript, feature, start, stop FROM r")
def _(t):
    return gm.canonical_rows(_gtf(t), _canonical(t)).select(F.col("attributes")["transcript_id"].alias("transcript"), "feature", "start", "stop")


@query(
    "exons_without_utr",
    f"""WITH x AS ({_TXS}), ex AS (SELECT tx, gene, chrom, s AS a, s + 400 AS b FROM x WHERE k % 2 = 0 UNION ALL SELECT tx, gene, chrom, s + 500, s + 900 FROM x WHERE k % 2 = 0), u0 AS (SELECT gene, chrom, s + 100 AS a, s + 100 + z * 10 AS b FROM x WHERE k % 3 = 0),
      ps AS (SELECT tx, ex.a, ex.b, unnest(list_sort(list_distinct(list_concat([ex.a, ex.b], list_concat(coalesce(list(u.a) FILTER (u.a > ex.a AND u.a < ex.b), []), coalesce(list(u.b) FILTER (u.b > ex.a AND u.b < ex.b), [])))))) AS p, any_value(ex.gene) AS gene, any_value(ex.chrom) AS chrom FROM ex LEFT JOIN u0 u ON u.gene = ex.gene AND u.chrom = ex.chrom AND u.a < ex.b AND ex.a < u.b GROUP BY tx, ex.a, ex.b),
      pc AS (SELECT tx, a, b, gene, chrom, p AS s, lead(p) OVER (PARTITION BY tx, a, b ORDER BY p) AS e FROM ps),
      fr AS (SELECT * FROM pc WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u0 WHERE u0.gene = pc.gene AND u0.chrom = pc.chrom AND u0.a < pc.e AND pc.s < u0.b)),
      rn AS (SELECT *, sum(nw) OVER (PARTITION BY tx, a, b ORDER BY s) AS g FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY tx, a, b ORDER BY s) = s THEN 0 ELSE 1 END AS nw FROM fr) q)
      SELECT tx AS transcript, min(s) AS start, max(e) AS stop FROM rn GROUP BY tx, a, b, g""",
)
def _(t):
    return gm.trim_exons(_gtf(t)).where("feature = 'exon'").select(F.col("attributes")["transcript_id"].alias("transcript"), "start", "stop")


# ---- mosaic events of parents ----------------------------------------------------------------

_MOM = "SELECT substr(name, 2) AS name, svtype, algorithms, vf / 10 AS vf, CASE WHEN svsize % 3 = 0 THEN 1 ELSE 0 END AS n_children, CAST(rd_log_pval AS DOUBLE) AS rd_log_pval, CAST(rd_log_2nd_max_p AS DOUBLE) AS rd_log_2nd_max_p, CAST(poor_region_cov AS DOUBLE) AS poor_region_cov FROM fx_metrics"
_MOC = "m AS (SELECT name, CASE WHEN algorithms <> 'depth' THEN 'reads' WHEN svtype = 'DEL' THEN 'depth_del' ELSE 'depth_dup' END AS class, rd_log_pval AS p, rd_log_2nd_max_p AS q, poor_region_cov AS x FROM ({s}) z WHERE svtype IN ('DEL', 'DUP') AND vf < 0.02 AND n_children = 0), cand AS (SELECT name, class FROM m WHERE q >= 2.05 AND x <= 0.3 AND CASE class WHEN 'reads' THEN p >= 3 AND q >= 2.5 WHEN 'depth_del' THEN p >= 2 AND q >= 3 ELSE p >= 4 AND q >= 2 END)".replace("{s}", _MOM)


def _mosaics(t):
    return mo.mosaic_candidates_by_depth(t.sql(_MOM), {"reads": (3.0, 2.5), "depth_del": (2.0, 3.0), "depth_dup": (4.0, 2.0)}, max_frequency=0.02)


@query("mosaic_depth_candidates", f"WITH {_MOC} SELECT name, class FROM cand")
def _(t):
    return _mosaics(t)


@query(
    "mosaic_sites",
    f"""WITH RECURSIVE {_MOC}, k AS (SELECT fx_calls.* FROM fx_calls JOIN cand USING (name) WHERE stop - start >= 5000), n AS (SELECT name AS node FROM k),
      e AS (SELECT a.name AS a, b.name AS b FROM k a JOIN k b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.name <> b.name AND a.start < b.stop AND b.start < a.stop AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (a.stop - a.start) AND least(a.stop, b.stop) - greatest(a.start, b.start) >= 0.8 * (b.stop - b.start)),
      {CC}, per AS (SELECT label, chrom, svtype, sample, min(start) AS start, max(stop) AS stop FROM k JOIN lab ON lab.node = k.name GROUP BY label, chrom, svtype, sample)
      SELECT label AS vid, chrom, svtype, CAST(floor(median(start)) AS BIGINT) AS start, CAST(floor(median(stop)) AS BIGINT) AS stop, string_agg(sample, ',' ORDER BY sample) AS samples FROM per GROUP BY label, chrom, svtype""",
)
def _(t):
    return mo.mosaic_sites(t.calls, _mosaics(t))


@query(
    "mosaic_events",
    f"""WITH {_MAT}, b AS (SELECT vid, grp, median(CASE WHEN treat THEN depth END) AS tr, median(CASE WHEN NOT treat THEN depth END) AS ct FROM inn GROUP BY vid, grp), s AS (SELECT vid, max(CASE WHEN svtype = 'DEL' THEN ct - tr ELSE tr - ct END) AS sep FROM b JOIN ev USING (vid) GROUP BY vid),
      r AS (SELECT *, row_number() OVER (ORDER BY sep, vid) AS i, count(*) OVER () AS n FROM s WHERE sep IS NOT NULL), q AS (SELECT max(CASE WHEN i = n // 4 THEN sep END) AS a, max(CASE WHEN i = n * 3 // 4 THEN sep END) AS b FROM r)
      SELECT vid, round(sep, 6) AS separation FROM r, q WHERE sep <= a - 1.5 * (b - a)""",
)
def _(t):
    d = mo.mosaic_separation(dp.inner_bins(_matrix(t), t.carriers), t.sql(_EV))
    return mo.below_fence(d).withColumn("separation", r6("separation"))
