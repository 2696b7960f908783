"""Reading, writing, converting and standardising records."""

from pyspark.sql import functions as F

from ..sources import callers as ca
from ..sources import vcf
from .registry import query

def _names(t):
    # cohort-sized list for the header line
    return [r["sample"] for r in t.samples.select("sample").distinct().orderBy(F.expr("cast(substring(sample, 2) as int)")).collect()]


_LINE = """concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), vid, 'N', alt, CAST(qual AS VARCHAR), filter, concat_ws(';', concat('END=', CAST(stop AS VARCHAR)), concat('SVTYPE=', svtype), concat('CHR2=', chr2), concat('STRANDS=', strands), concat('SVLEN=', CAST(svlen AS VARCHAR)),
   concat('ALGORITHMS=', algorithms), concat('EVIDENCE=', evidence), 'CPX_TYPE=' || cpx_type, 'CPX_INTERVALS=' || cpx_intervals))"""


@query("write_vcf_site_lines", f"SELECT chrom, pos, {_LINE} AS value FROM fx_sites")
def _(t):
    return vcf.to_vcf_lines(t.sites)


@query("read_vcf_sites", "SELECT vid, chrom, pos, stop, svlen, svtype, chr2, strands, alt, CAST(qual AS DOUBLE) AS qual, filter, algorithms, evidence, cpx_type, cpx_intervals FROM fx_sites")
def _(t):
    lines = vcf.to_vcf_lines(t.sites, t.genotypes, _names(t)).select("value")
    s, _ = vcf.parse_vcf_lines(lines, _names(t))
    return s.select("vid", "chrom", "pos", "stop", "svlen", "svtype", "chr2", "strands", "alt", "qual", "filter", "algorithms", "evidence", "cpx_type", "cpx_intervals")


@query("read_vcf_genotypes", "SELECT s.vid, p.sample, a1, a2, gq, rd_cn FROM fx_sites s CROSS JOIN fx_samples p LEFT JOIN fx_genotypes g ON g.vid = s.vid AND g.sample = p.sample")
def _(t):
    lines = vcf.to_vcf_lines(t.sites, t.genotypes, _names(t)).select("value")
    _, g = vcf.parse_vcf_lines(lines, _names(t))
    return g.select("vid", "sample", "a1", "a2", "gq", "rd_cn")


_BED = """b AS (SELECT vid AS name, strands, chrom, greatest(pos - 1, 0) AS start, pos AS stop, svtype FROM fx_sites WHERE svtype = 'BND'
   UNION ALL SELECT vid, strands, chr2, greatest(stop - 1, 0), stop, svtype FROM fx_sites WHERE svtype = 'BND'
   UNION ALL SELECT vid, strands, chrom, greatest(least(pos, stop) - 1, 0), greatest(pos, stop), 'DEL' FROM fx_sites WHERE svtype = 'INS'"""


@query("vcf_to_bed", f"WITH {_BED} UNION ALL SELECT vid, strands, chrom, greatest(least(pos, stop) - 1, 0), CASE WHEN greatest(least(pos, stop) - 1, 0) = greatest(pos, stop) THEN greatest(pos, stop) + 1 ELSE greatest(pos, stop) END, svtype FROM fx_sites WHERE svtype NOT IN ('BND', 'INS')) SELECT * FROM b")
def _(t):
    return vcf.vcf_to_bed(t.sites)


@query(
    "vcf_to_bed_split_complex",
    rf"""WITH {_BED} UNION ALL SELECT vid, strands, chrom, greatest(least(pos, stop) - 1, 0), greatest(pos, stop), svtype FROM fx_sites WHERE svtype NOT IN ('BND', 'INS', 'CPX')
      UNION ALL SELECT vid, strands, regexp_extract(x, '_([^:]+):', 1), greatest(CAST(regexp_extract(x, ':(\d+)-', 1) AS BIGINT) - 1, 0), CAST(regexp_extract(x, '-(\d+)$', 1) AS BIGINT), regexp_extract(x, '^([^_]+)_', 1) FROM (SELECT *, unnest(string_split(cpx_intervals, ',')) AS x FROM fx_sites WHERE svtype = 'CPX') y
      UNION ALL SELECT vid, strands, chrom, greatest(pos - 1, 0), pos, 'DEL' FROM fx_sites WHERE cpx_type IN ('dDUP', 'INS_iDEL')) SELECT * FROM b""",
)
def _(t):
    return vcf.vcf_to_bed(t.sites, split_cpx=True)


_RB = "SELECT chrom, svtype, start - start % 5000 AS start, start - start % 5000 + 3000 AS stop, concat(chrom, '_', svtype, '_', CAST(start - start % 5000 AS STRING)) AS name, sample FROM fx_calls"


@query("calls_to_test_bed", f"WITH c AS ({_RB}) SELECT chrom, start, stop, name, upper(svtype) AS svtype, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM c GROUP BY ALL")
def _(t):
    return vcf.calls_to_test_bed(t.sql(_RB))


@query(
    "bed_to_variants",
    f"""WITH c AS ({_RB}), b AS (SELECT chrom, start, stop, name, svtype, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM c GROUP BY chrom, start, stop, name, svtype), k AS (SELECT sample FROM fx_samples WHERE batch = 'B0')
      SELECT name AS vid, chrom, greatest(start, 1) AS pos, stop, svtype, chrom AS chr2, CASE svtype WHEN 'DEL' THEN '+-' WHEN 'DUP' THEN '-+' END AS strands, stop - start AS svlen, 'depth' AS algorithms FROM b WHERE EXISTS (SELECT 1 FROM k WHERE contains(concat(',', samples, ','), concat(',', k.sample, ',')))""",
)
def _(t):
    return vcf.bed_to_sites(vcf.calls_to_test_bed(t.sql(_RB)), t.samples.where("batch = 'B0'"))[0]


@query(
    "merge_evidence_files",
    """WITH u AS (SELECT chrom, pos, clip, CASE WHEN sample = 'S1' THEN 'R1' ELSE sample END AS sample, cnt FROM fx_sr WHERE clip = 'left' UNION ALL SELECT chrom, pos, clip, sample, cnt FROM fx_sr WHERE clip = 'right')
      SELECT * FROM u WHERE EXISTS (SELECT 1 FROM fx_regions r WHERE r.chrom = u.chrom AND u.pos >= r.start AND u.pos < r.stop)""",
)
def _(t):
    s = t.sr
    return vcf.merge_evidence([(s.where("clip = 'left'"), {"S1": "R1"}), (s.where("clip = 'right'"), {})], t.regions)


_IDS = "SELECT CASE WHEN c_custkey % 50 = 0 THEN concat('S-', CAST(c_custkey AS STRING)) WHEN c_custkey % 70 = 1 THEN 'chrom_x' ELSE concat('S', CAST(c_custkey AS STRING)) END AS sample FROM customer"


@query(
    "sample_id_checks",
    f"""WITH i AS ({_IDS}), n AS (SELECT sample, count(*) AS n FROM i GROUP BY sample) SELECT sample, n > 1 AS duplicate, NOT regexp_full_match(sample, '[A-Za-z0-9_]+') AS bad_characters,
      (lower(sample) LIKE '%chr%' OR lower(sample) LIKE '%name%' OR lower(sample) LIKE '%del%' OR lower(sample) LIKE '%dup%' OR lower(sample) LIKE '%cpx%') AS reserved, EXISTS (SELECT 1 FROM n m WHERE m.sample <> n.sample AND contains(m.sample, n.sample)) AS is_substring FROM n""",
)
def _(t):
    return vcf.check_sample_ids(t.sql(_IDS))


@query("replace_sample_ids", "SELECT sample, concat('NEW_', sample) AS new_id FROM fx_samples")
def _(t):
    return vcf.replace_ids(t.samples.select("sample"), t.samples.select("sample", F.concat(F.lit("NEW_"), "sample").alias("new_id")))


@query("rename_samples", "SELECT vid, concat(batch, '_', sample) AS sample, a1, a2 FROM fx_genotypes JOIN fx_samples USING (sample)")
def _(t):
    m = t.samples.select("sample", F.concat_ws("_", "batch", "sample").alias("new"))
    return t.genotypes.join(m, "sample").select("vid", F.col("new").alias("sample"), "a1", "a2")


@query("split_by_size_and_type", "SELECT vid, CASE WHEN svtype IN ('DEL', 'DUP') AND svlen < 5000 THEN 'small_cnv' WHEN svtype IN ('DEL', 'DUP') THEN 'large_cnv' ELSE 'other' END AS class FROM fx_sites")
def _(t):
    cnv = F.col("svtype").isin("DEL", "DUP")
    return t.sites.select("vid", F.when(cnv & (F.col("svlen") < 5000), "small_cnv").when(cnv, "large_cnv").otherwise("other").alias("class"))


@query(
    "breakends_to_mates",
    """WITH x AS (SELECT *, svtype IN ('DEL', 'DUP') AND evidence NOT LIKE '%RD%' AND svlen >= 1000 AS dm FROM fx_sites WHERE svtype IN ('BND', 'DEL', 'DUP')), b AS (SELECT * FROM x WHERE svtype = 'BND' OR dm)
      SELECT concat(vid, '_a') AS vid, chrom, pos, chr2, stop, strands FROM b UNION ALL SELECT concat(vid, '_b'), chr2, stop, chrom, pos, reverse(strands) FROM b""",
)
def _(t):
    cnv = F.col("svtype").isin("DEL", "DUP")
    b = t.sites.where((F.col("svtype") == "BND") | (cnv & ~F.col("evidence").contains("RD") & (F.col("svlen") >= 1000)))
    rows = F.array(
        F.struct(F.concat("vid", F.lit("_a")).alias("vid"), F.col("chrom"), F.col("pos"), F.col("chr2"), F.col("stop"), F.col("strands")),
        F.struct(F.concat("vid", F.lit("_b")).alias("vid"), F.col("chr2").alias("chrom"), F.col("stop").alias("pos"), F.col("chrom").alias("chr2"), F.col("pos").alias("stop"), F.reverse("strands").alias("strands")),
    )
    return b.select(F.inline(rows))


_C7 = "concat('chr', CAST(1 + {x} % 6 AS STRING))"
_RAW = f"""SELECT concat('R:', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS vid, concat('chr', CAST(1 + l_suppkey % 5 AS STRING)) AS chrom, (l_partkey * 7919 + l_orderkey * 31) % 2000000 AS pos,
   CASE WHEN l_partkey % 5 = 4 THEN 1 + (l_orderkey * 17) % 2000000 ELSE (l_partkey * 7919 + l_orderkey * 31) % 2000000 + CAST(l_quantity AS BIGINT) * 40 - 30 END AS stop,
   CASE l_partkey % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'INS' ELSE '@' END AS svtype, CASE WHEN l_partkey % 5 = 4 THEN {_C7.format(x='l_orderkey')} END AS chr2,
   CASE l_partkey % 5 WHEN 0 THEN '3to5' WHEN 1 THEN '5to3' WHEN 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN '3to3' ELSE '5to5' END WHEN 3 THEN 'NtoN' ELSE CASE l_linenumber % 4 WHEN 0 THEN '3to3' WHEN 1 THEN '5to5' WHEN 2 THEN '3to5' ELSE '5to3' END END AS ct,
   CASE WHEN l_partkey % 5 = 4 THEN CASE l_linenumber % 4 WHEN 0 THEN concat('N]', {_C7.format(x='l_orderkey')}, ':', CAST(1 + (l_orderkey * 17) % 2000000 AS STRING), ']') WHEN 1 THEN concat('[', {_C7.format(x='l_orderkey')}, ':', CAST(1 + (l_orderkey * 17) % 2000000 AS STRING), '[N')
     WHEN 2 THEN concat('N[', {_C7.format(x='l_orderkey')}, ':', CAST(1 + (l_orderkey * 17) % 2000000 AS STRING), '[') ELSE concat(']', {_C7.format(x='l_orderkey')}, ':', CAST(1 + (l_orderkey * 17) % 2000000 AS STRING), ']N') END ELSE '<SV>' END AS alt,
   l_linenumber = 7 AND l_suppkey % 2 = 0 AS secondary, l_linenumber % 2 = 0 AS inv3, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) * 20 AS BIGINT) END AS svlen,
   CASE l_partkey % 5 WHEN 0 THEN '+-:4' WHEN 1 THEN '-+:3,+-:2' WHEN 2 THEN '++:3,--:5' WHEN 3 THEN '+-:9' ELSE CASE l_linenumber % 4 WHEN 0 THEN '++:4' WHEN 1 THEN '--:4' WHEN 2 THEN '+-:4' ELSE '-+:6' END END AS sl FROM lineitem"""
_OK5 = "('chr1', 'chr2', 'chr3', 'chr4', 'chr5')"
_FILT = f"f AS (SELECT * REPLACE (greatest(pos, 1) AS pos) FROM raw WHERE NOT secondary AND chrom IN {_OK5} AND (chr2 IS NULL OR chr2 IN {_OK5}))"
_FIN = "SELECT vid, chrom, pos, stop, chr2, svtype, strands, svlen, CASE WHEN svtype = 'BND' THEN CASE strands WHEN '++' THEN concat('N]', chr2, ':', CAST(stop AS VARCHAR), ']') WHEN '+-' THEN concat('N[', chr2, ':', CAST(stop AS VARCHAR), '[') WHEN '-+' THEN concat(']', chr2, ':', CAST(stop AS VARCHAR), ']N') ELSE concat('[', chr2, ':', CAST(stop AS VARCHAR), '[N') END ELSE {alt} END AS alt, '{n}' AS algorithms FROM s WHERE NOT (svlen > 0 AND svlen < 50) AND NOT (svtype = 'INS' AND svlen = -1) AND strands IN ('++', '+-', '-+', '--')"
_CONT = ["chr1", "chr2", "chr3", "chr4", "chr5"]


def _raw(t, bnd):
    return t.sql(_RAW.replace("'@'", f"'{bnd}'")).withColumn("strand_list", F.split("sl", ","))


@query(
    "standardize_delly",
    f"""WITH raw AS ({_RAW.replace("'@'", "'TRA'")}), {_FILT}, g AS (SELECT *, CASE ct WHEN '5to3' THEN '-+' WHEN '3to3' THEN '++' WHEN '5to5' THEN '--' ELSE '+-' END AS st, svtype = 'TRA' AND chrom > chr2 AS sw FROM f),
      s AS (SELECT vid, CASE WHEN sw THEN chr2 ELSE chrom END AS chrom, CASE WHEN sw THEN stop ELSE pos END AS pos, CASE WHEN sw THEN pos ELSE stop END AS stop, CASE WHEN sw OR svtype <> 'TRA' THEN chrom ELSE chr2 END AS chr2, CASE WHEN svtype = 'TRA' THEN 'BND' ELSE svtype END AS svtype, CASE WHEN sw THEN reverse(st) ELSE st END AS strands,
        CASE WHEN svtype = 'TRA' AND chrom <> chr2 THEN -1 ELSE stop - pos END AS svlen FROM g) {_FIN.format(alt="concat('<', svtype, '>')", n='delly')}""",
)
def _(t):
    return ca.standardize(_raw(t, "TRA"), "delly", _CONT)


@query(
    "standardize_manta",
    f"""WITH raw0 AS ({_RAW.replace("'@'", "'BND'")}), raw AS (SELECT *, CASE WHEN svtype = 'BND' THEN concat(vid, ':1') END AS mate_id FROM raw0 UNION ALL SELECT * REPLACE (concat(vid, ':1') AS vid, pos + 3 AS pos), vid FROM raw0 WHERE svtype = 'BND'), {_FILT},
      k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY CASE WHEN mate_id IS NULL THEN vid ELSE concat(least(vid, mate_id), '|', greatest(vid, mate_id)) END ORDER BY chrom, pos, vid) = 1),
      g AS (SELECT *, CASE svtype WHEN 'INV' THEN CASE WHEN inv3 THEN '++' ELSE '--' END WHEN 'DUP' THEN '-+' WHEN 'BND' THEN CASE WHEN ends_with(alt, '[') THEN '+-' WHEN ends_with(alt, ']') THEN '++' WHEN starts_with(alt, ']') THEN '-+' ELSE '--' END ELSE '+-' END AS strands0, svtype = 'BND' AND chrom > chr2 AS sw, CASE WHEN svtype = 'INS' THEN pos + 1 ELSE stop END AS e FROM k),
      s AS (SELECT replace(vid, ':', '_') AS vid, CASE WHEN sw THEN chr2 ELSE chrom END AS chrom, CASE WHEN sw THEN e ELSE pos END AS pos, CASE WHEN sw THEN pos ELSE e END AS stop, CASE WHEN sw OR svtype <> 'BND' THEN chrom ELSE chr2 END AS chr2, svtype, strands0 AS strands, CASE WHEN svtype = 'INS' THEN coalesce(svlen, -1) WHEN svtype = 'BND' AND chrom <> chr2 THEN -1 ELSE e - pos END AS svlen FROM g) {_FIN.format(alt="concat('<', svtype, '>')", n='manta')}""",
)
def _(t):
    r = _raw(t, "BND")
    m = r.where("svtype = 'BND'").select(*[(F.concat("vid", F.lit(":1")) if c == "vid" else F.col("pos") + 3 if c == "pos" else F.col(c)).alias(c) for c in r.columns], F.col("vid").alias("mate_id"))
    r = r.withColumn("mate_id", F.when(F.col("svtype") == "BND", F.concat("vid", F.lit(":1")))).unionByName(m)
    return ca.standardize(r, "manta", _CONT)


_LUMPY = f"""WITH raw AS ({_RAW.replace("'@'", "'BND'")}), {_FILT}, u AS (SELECT *, unnest(string_split(sl, ',')) AS one, generate_subscripts(string_split(sl, ','), 1) AS ix FROM f), g AS (SELECT *, split_part(one, ':', 1) AS st, svtype = 'BND' AND chrom > chr2 AS sw FROM u),
  h AS (SELECT vid, ix, CASE WHEN sw THEN chr2 ELSE chrom END AS chrom, CASE WHEN sw THEN stop ELSE pos END AS pos, CASE WHEN sw THEN pos ELSE stop END AS stop, CASE WHEN sw OR svtype <> 'BND' THEN chrom ELSE chr2 END AS chr2, svtype AS t0, CASE WHEN sw THEN reverse(st) ELSE st END AS strands FROM g),
  i AS (SELECT *, CASE WHEN t0 = 'BND' AND chrom = chr2 THEN CASE strands WHEN '+-' THEN 'DEL' WHEN '-+' THEN 'DUP' ELSE 'INV' END ELSE t0 END AS svtype, CASE WHEN chrom = chr2 THEN stop - pos ELSE -1 END AS svlen FROM h),
  s AS (SELECT concat(vid, substr('abcd', CAST(ix AS BIGINT), 1)) AS vid, chrom, pos, stop, chr2, svtype, strands, svlen FROM i WHERE NOT (svtype = 'DEL' AND strands <> '+-') AND NOT (svtype = 'DUP' AND strands <> '-+') AND NOT (svtype = 'INV' AND strands NOT IN ('++', '--')))"""


@query("standardize_lumpy", f"{_LUMPY} {_FIN.format(alt=chr(99) + 'oncat(' + repr('<') + ', svtype, ' + repr('>') + ')', n='lumpy')}")
def _(t):
    return ca.standardize(_raw(t, "BND"), "lumpy", _CONT)


@query("standardize_smoove", f"{_LUMPY} {_FIN.format(alt=chr(99) + 'oncat(' + repr('<') + ', svtype, ' + repr('>') + ')', n='smoove')}")
def _(t):
    return ca.standardize(_raw(t, "BND"), "smoove", _CONT)


_NB = "f AS (SELECT * REPLACE (greatest(pos, 1) AS pos) FROM raw WHERE NOT secondary AND svtype <> 'BND')"


@query("standardize_melt", f"WITH raw AS ({_RAW.replace(chr(39) + '@' + chr(39), chr(39) + 'BND' + chr(39))}), {_NB}, s AS (SELECT vid, chrom, pos, pos + 1 AS stop, chrom AS chr2, 'INS' AS svtype, '+-' AS strands, coalesce(svlen, -1) AS svlen, alt FROM f) {_FIN.format(alt='alt', n='melt')}")
def _(t):
    r = _raw(t, "BND").where("svtype <> 'BND'").withColumn("svlen", F.coalesce("svlen", F.lit(-1).cast("long")))
    return ca.standardize(r, "melt", _CONT)


@query("standardize_wham", f"WITH raw AS ({_RAW.replace(chr(39) + '@' + chr(39), chr(39) + 'BND' + chr(39))}), {_NB}, s AS (SELECT replace(vid, ':', '_') AS vid, chrom, pos, stop, chrom AS chr2, svtype, CASE svtype WHEN 'DEL' THEN '+-' WHEN 'DUP' THEN '-+' ELSE '.' END AS strands, abs(coalesce(svlen, 10)) AS svlen, alt FROM f) {_FIN.format(alt='alt', n='wham')}")
def _(t):
    r = _raw(t, "BND").where("svtype <> 'BND'").withColumn("svlen", F.coalesce("svlen", F.lit(10).cast("long")))
    return ca.standardize(r, "wham", _CONT)


@query(
    "standardized_variant_ids",
    f"""WITH raw AS ({_RAW.replace("'@'", "'BND'")}), {_NB}, s AS (SELECT replace(vid, ':', '_') AS vid, chrom, pos, stop, svtype, CASE svtype WHEN 'DEL' THEN '+-' WHEN 'DUP' THEN '-+' ELSE '.' END AS strands, abs(coalesce(svlen, 10)) AS svlen FROM f)
      SELECT concat('wham_', CAST(row_number() OVER (ORDER BY chrom, pos, stop, vid) AS VARCHAR)) AS vid, chrom, pos, stop FROM s WHERE strands <> '.' AND svlen >= 50""",
)
def _(t):
    r = _raw(t, "BND").where("svtype <> 'BND'").withColumn("svlen", F.coalesce("svlen", F.lit(10).cast("long")))
    return ca.standardize(r, "wham", _CONT, prefix="wham").select("vid", "chrom", "pos", "stop")


@query("copy_caller_genotypes", "SELECT vid, sample, CASE WHEN a1 IS NULL AND a2 IS NULL THEN 0 ELSE a1 END AS a1, CASE WHEN a1 IS NULL AND a2 IS NULL THEN 1 ELSE a2 END AS a2, CAST(CASE WHEN (a1 IS NULL AND a2 IS NULL) OR a1 > 0 OR a2 > 0 THEN 1 ELSE 0 END AS INT) AS support FROM fx_genotypes")
def _(t):
    return ca.copy_genotypes(t.genotypes.select("vid", "sample", "a1", "a2"), True)


@query("parse_breakend_alt", f"WITH raw AS ({_RAW}) SELECT vid, chr2, stop AS pos2, CASE WHEN ends_with(alt, '[') THEN '+-' WHEN ends_with(alt, ']') THEN '++' WHEN starts_with(alt, ']') THEN '-+' ELSE '--' END AS strands FROM raw WHERE svtype = '@'")
def _(t):
    c, p, s = ca.parse_mate("alt")
    return t.sql(_RAW).where("svtype = '@'").select("vid", c.alias("chr2"), p.alias("pos2"), s.alias("strands"))
