"""Derived cohort tables over the generic test tables.

Every derivation is plain arithmetic on keys in SQL that Spark and an ANSI engine both
accept, so that the same text feeds the Spark queries and their SQL counterparts.
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SITE_CHROM = "CASE WHEN {k} % 7 < 5 THEN concat('chr', CAST(1 + {k} % 7 AS STRING)) WHEN {k} % 7 = 5 THEN 'chrX' ELSE 'chrY' END"
_SITE_POS = "(1 + ({k} * 9973) % 2000000)"
_SITE_TYPE = (
    "CASE ({k} + {s}) % 10 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DEL' WHEN 2 THEN 'DEL' WHEN 3 THEN 'DUP' WHEN 4 THEN 'DUP' "
    "WHEN 5 THEN 'INV' WHEN 6 THEN 'INS' WHEN 7 THEN 'BND' WHEN 8 THEN 'CPX' ELSE 'CNV' END"
)
_SITE_STRANDS = (
    "CASE ({k} + {s}) % 10 WHEN 3 THEN '-+' WHEN 4 THEN '-+' WHEN 5 THEN CASE WHEN {s} % 2 = 0 THEN '++' ELSE '--' END "
    "WHEN 7 THEN CASE {k} % 4 WHEN 0 THEN '++' WHEN 1 THEN '+-' WHEN 2 THEN '-+' ELSE '--' END ELSE '+-' END"
)
_SITE_END = "CASE WHEN ({k} + {s}) % 10 = 6 THEN {p} + 1 WHEN ({k} + {s}) % 10 = 7 THEN 1 + ({k} * 7919) % 2000000 ELSE {p} + {s} * {s} * 20 END"


def _site(expr: str, k: str, s: str) -> str:
    return expr.format(k=k, s=s, p=_SITE_POS.format(k=k))


FIXTURES: dict[str, str] = {
    # copy-number and inversion calls per sample (BED-like)
    "fx_calls": """
        SELECT concat('chr', CAST(1 + l_suppkey % 5 AS STRING)) AS chrom,
          (l_partkey * 7919 + l_orderkey * 31) % 2000000 AS start,
          (l_partkey * 7919 + l_orderkey * 31) % 2000000 + 50 + CAST(l_quantity AS BIGINT) * 200 AS stop,
          concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS name,
          concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample,
          CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'R' THEN 'DUP' ELSE 'INV' END AS svtype
        FROM lineitem""",
    # one variant site per part
    "fx_sites": f"""
        SELECT concat('v', CAST(p_partkey AS STRING)) AS vid,
          {_site(_SITE_CHROM, 'p_partkey', 'p_size')} AS chrom,
          {_site(_SITE_POS, 'p_partkey', 'p_size')} AS pos,
          CAST({_site(_SITE_END, 'p_partkey', 'p_size')} AS BIGINT) AS stop,
          {_site(_SITE_TYPE, 'p_partkey', 'p_size')} AS svtype,
          CASE WHEN (p_partkey + p_size) % 10 = 7 THEN concat('chr', CAST(1 + (p_partkey + 1) % 5 AS STRING)) ELSE {_site(_SITE_CHROM, 'p_partkey', 'p_size')} END AS chr2,
          {_site(_SITE_STRANDS, 'p_partkey', 'p_size')} AS strands,
          CAST(CASE WHEN (p_partkey + p_size) % 10 = 6 THEN CASE WHEN p_size % 10 = 0 THEN -1 ELSE p_size * 30 END WHEN (p_partkey + p_size) % 10 = 7 THEN -1 ELSE p_size * p_size * 20 END AS BIGINT) AS svlen,
          CASE WHEN (p_partkey + p_size) % 10 = 6 AND p_size % 3 = 0 THEN '<INS:ME:ALU>' ELSE concat('<', {_site(_SITE_TYPE, 'p_partkey', 'p_size')}, '>') END AS alt,
          CASE p_partkey % 6 WHEN 0 THEN 'depth' WHEN 1 THEN 'manta' WHEN 2 THEN 'wham' WHEN 3 THEN 'melt' WHEN 4 THEN 'manta,wham' ELSE 'depth,manta' END AS algorithms,
          CASE p_size % 7 WHEN 0 THEN 'RD' WHEN 1 THEN 'PE' WHEN 2 THEN 'SR' WHEN 3 THEN 'PE,SR' WHEN 4 THEN 'PE,RD' WHEN 5 THEN 'BAF,RD' ELSE 'PE,RD,SR' END AS evidence,
          CASE p_partkey % 9 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'HIGH_SR_BACKGROUND' WHEN 2 THEN 'MULTIALLELIC' ELSE 'PASS' END AS filter,
          CAST(1 + (p_partkey * 17) % 999 AS BIGINT) AS qual,
          CASE WHEN (p_partkey + p_size) % 10 <> 8 THEN NULL WHEN p_size % 4 = 0 THEN 'dDUP' WHEN p_size % 4 = 1 THEN 'delINV' WHEN p_size % 4 = 2 THEN 'INS_iDEL' ELSE 'dupINVdup' END AS cpx_type,
          CASE WHEN (p_partkey + p_size) % 10 <> 8 THEN NULL ELSE concat(
            CASE WHEN p_size % 2 = 0 THEN 'DUP_' ELSE 'DEL_' END, {_site(_SITE_CHROM, 'p_partkey', 'p_size')}, ':', CAST({_site(_SITE_POS, 'p_partkey', 'p_size')} AS STRING), '-', CAST({_site(_SITE_POS, 'p_partkey', 'p_size')} + p_size * 10 AS STRING),
            ',INV_', {_site(_SITE_CHROM, 'p_partkey', 'p_size')}, ':', CAST({_site(_SITE_POS, 'p_partkey', 'p_size')} + p_size * 10 AS STRING), '-', CAST({_site(_SITE_POS, 'p_partkey', 'p_size')} + p_size * p_size * 20 AS STRING)) END AS cpx_intervals
        FROM part""",
    # long genotype table
    "fx_genotypes": """
        SELECT concat('v', CAST(l_partkey AS STRING)) AS vid, concat('S', CAST(k AS STRING)) AS sample,
          CAST(CASE WHEN h % 8 = 5 THEN 1 WHEN h % 8 = 6 THEN NULL ELSE 0 END AS INT) AS a1,
          CAST(CASE WHEN h % 8 IN (3, 4, 5, 7) THEN 1 WHEN h % 8 = 6 THEN NULL ELSE 0 END AS INT) AS a2,
          CAST((h * 13 + k) % 100 AS INT) AS gq,
          CAST(CASE WHEN h % 16 < 10 THEN 2 WHEN h % 16 < 12 THEN 1 WHEN h % 16 < 14 THEN 3 WHEN h % 16 = 14 THEN 0 ELSE 4 END AS INT) AS rd_cn,
          CAST((h * 11 + k) % 1000 AS INT) AS rd_gq,
          CAST(CASE WHEN h % 5 < 3 THEN 0 WHEN h % 5 = 3 THEN 1 ELSE 1 + h % 3 END AS INT) AS pe_gt,
          CAST((h * 17 + k) % 1000 AS INT) AS pe_gq,
          CAST(CASE WHEN h % 7 < 4 THEN 0 WHEN h % 7 < 6 THEN 1 ELSE 2 END AS INT) AS sr_gt,
          CAST((h * 19 + k) % 1000 AS INT) AS sr_gq,
          CAST(1 + h % 7 AS INT) AS ev
        FROM (SELECT l_partkey, l_orderkey % 40 AS k, max(l_orderkey * 7 + l_linenumber * 3) AS h FROM lineitem GROUP BY l_partkey, l_orderkey % 40) g""",
    "fx_carriers": "SELECT vid, sample FROM fx_genotypes WHERE a1 + a2 > 0",
    # samples: pedigree, population, batch, library type
    "fx_ped": """
        SELECT concat('F', CAST((k - k % 4) AS STRING)) AS family, concat('S', CAST(k AS STRING)) AS sample,
          CASE WHEN k % 4 >= 2 THEN concat('S', CAST(k - k % 4 AS STRING)) END AS father,
          CASE WHEN k % 4 >= 2 THEN concat('S', CAST(k - k % 4 + 1 AS STRING)) END AS mother,
          CAST(1 + k % 2 AS INT) AS sex, CAST(1 + (k % 3) % 2 AS INT) AS phenotype
        FROM (SELECT DISTINCT l_orderkey % 40 AS k FROM lineitem) s""",
    "fx_samples": """
        SELECT concat('S', CAST(k AS STRING)) AS sample, r_name AS pop, CASE WHEN k % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS sex,
          concat('B', CAST(k % 3 AS STRING)) AS batch, CASE WHEN k % 4 = 3 THEN 'PCRPLUS' ELSE 'PCRMINUS' END AS pcr
        FROM (SELECT DISTINCT l_orderkey % 40 AS k FROM lineitem) s JOIN region ON r_regionkey = k % 5""",
    # gene elements: four rows per gene
    "fx_genes": """
        SELECT concat('chr', CAST(1 + g % 5 AS STRING)) AS chrom,
          CASE e WHEN 2 THEN gs + 500 + p_size * 10 WHEN 3 THEN CASE WHEN g % 3 = 0 THEN gs - 1000 ELSE gs END ELSE gs END AS start,
          CASE e WHEN 2 THEN gs + 900 + p_size * 30 WHEN 3 THEN CASE WHEN g % 3 = 0 THEN gs ELSE gs + 300 END ELSE gs + len END AS stop,
          CASE e WHEN 0 THEN 'gene' WHEN 1 THEN 'transcript' WHEN 2 THEN 'CDS' ELSE CASE WHEN g % 3 = 0 THEN 'promoter' ELSE 'UTR' END END AS element,
          concat('G', CAST(g AS STRING)) AS gene, CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM (SELECT p_size, p_partkey % 4 AS e, (p_partkey - p_partkey % 4) / 4 AS gd, CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT) AS g,
                1000 + (CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT) * 39877) % 1990000 AS gs,
                4000 + CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT) % 50 * 400 AS len FROM part) x""",
    "fx_regions": """
        SELECT concat('chr', CAST(1 + s_suppkey % 5 AS STRING)) AS chrom, (s_suppkey * 99991) % 1980000 AS start, (s_suppkey * 99991) % 1980000 + 20000 AS stop
        FROM supplier""",
    # binned coverage, long form
    "fx_bincov": """
        SELECT CASE WHEN l_suppkey % 7 < 5 THEN concat('chr', CAST(1 + l_suppkey % 7 AS STRING)) WHEN l_suppkey % 7 = 5 THEN 'chrX' ELSE 'chrY' END AS chrom,
          CAST(floor(l_partkey / 40) AS BIGINT) * 1000 AS start, CAST(floor(l_partkey / 40) AS BIGINT) * 1000 + 1000 AS stop,
          concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cov
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    # split reads near both ends of each site
    "fx_sr": f"""
        SELECT chrom, pos, clip, sample, CAST(sum(n) AS BIGINT) AS cnt FROM (
          SELECT {_site(_SITE_CHROM, 'l_partkey', 'p_size')} AS chrom,
            CASE WHEN l_suppkey % 2 = 0 THEN {_site(_SITE_POS, 'l_partkey', 'p_size')} ELSE {_site(_SITE_END, 'l_partkey', 'p_size')} END + l_linenumber - 4 AS pos,
            CASE WHEN (l_orderkey + l_suppkey) % 3 = 0 THEN 'left' ELSE 'right' END AS clip,
            concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample, CAST(l_quantity AS BIGINT) AS n
          FROM lineitem JOIN part ON l_partkey = p_partkey) x GROUP BY chrom, pos, clip, sample""",
    # discordant pairs spanning each site
    "fx_pe": f"""
        SELECT {_site(_SITE_CHROM, 'l_partkey', 'p_size')} AS chr_a, {_site(_SITE_POS, 'l_partkey', 'p_size')} - 120 + l_linenumber * 30 AS pos_a,
          substr({_site(_SITE_STRANDS, 'l_partkey', 'p_size')}, 1, 1) AS strand_a,
          CASE WHEN (p_partkey + p_size) % 10 = 7 THEN concat('chr', CAST(1 + (p_partkey + 1) % 5 AS STRING)) ELSE {_site(_SITE_CHROM, 'l_partkey', 'p_size')} END AS chr_b,
          {_site(_SITE_END, 'l_partkey', 'p_size')} + CAST(l_quantity AS BIGINT) * 12 - 300 AS pos_b,
          substr({_site(_SITE_STRANDS, 'l_partkey', 'p_size')}, 2, 1) AS strand_b,
          concat('S', CAST(l_orderkey % 40 AS STRING)) AS sample
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_baf": """
        SELECT concat('chr', CAST(1 + user_id % 5 AS STRING)) AS chrom, (event_id * 37) % 2000000 AS pos,
          (CAST(floor(value) AS BIGINT) % 100) / 100.0 AS baf, concat('S', CAST(user_id % 40 AS STRING)) AS sample
        FROM events""",
    # breakpoint records in linked clusters (one cluster per order)
    "fx_breaks": """
        SELECT concat('b', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS vid,
          concat('c', CAST(l_orderkey AS STRING)) AS cluster, concat('chr', CAST(1 + l_orderkey % 5 AS STRING)) AS chrom,
          CASE WHEN l_orderkey % 5 = 1 AND l_linenumber <= 4 THEN concat('chr', CAST(1 + (l_orderkey + 1) % 5 AS STRING)) ELSE concat('chr', CAST(1 + l_orderkey % 5 AS STRING)) END AS chr2,
          CASE WHEN l_linenumber > 5 THEN 'DEL' WHEN l_linenumber = 5 THEN 'DUP' WHEN l_orderkey % 5 IN (0, 4) THEN 'INV' WHEN l_orderkey % 5 = 3 AND l_linenumber <= 2 THEN 'INS' ELSE 'BND' END AS svtype,
          CASE WHEN l_linenumber > 5 THEN '+-' WHEN l_linenumber = 5 THEN '-+' WHEN l_orderkey % 5 IN (0, 4) THEN CASE WHEN l_linenumber % 2 = 0 THEN '++' ELSE '--' END
            WHEN l_orderkey % 10 < 5 THEN CASE WHEN l_linenumber % 2 = 0 THEN '++' ELSE '--' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN '+-' ELSE '-+' END END AS strands,
          1 + (l_orderkey * 1237) % 1900000 + (l_partkey % 9) * 150 AS pos,
          1 + (l_orderkey * 1237) % 1900000 + CASE WHEN l_linenumber >= 5 THEN (l_partkey % 9) * 150 + 400 + (l_suppkey % 5) * 200 ELSE 5000 + (l_suppkey % 9) * 170 END AS stop,
          CASE l_suppkey % 4 WHEN 0 THEN 'SR' WHEN 1 THEN 'PE' WHEN 2 THEN 'PE,SR' ELSE 'RD' END AS evidence
        FROM lineitem""",
    # evidence metrics, one row per candidate variant
    "fx_metrics": """
        SELECT concat('m', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS name,
          concat('chr', CAST(1 + l_suppkey % 5 AS STRING)) AS chrom,
          CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'BND' ELSE 'DEL' END AS svtype,
          CAST(50 + (l_partkey * 37) % 12000 AS BIGINT) AS svsize,
          (1 + l_orderkey % 200) / 400.0 AS vf,
          (l_partkey % 101) / 100.0 AS poor_region_cov,
          l_suppkey % 4 = 0 AS rmsk, l_orderkey % 11 = 0 AS is_outlier_specific,
          ((l_orderkey * 7 + l_partkey) % 1200) / 100.0 AS pe_log_pval, (l_orderkey % 50) * 1.0 AS pe_called_median, (l_partkey % 9) * 1.0 AS pe_bg_median,
          ((l_orderkey * 3 + l_partkey * 5) % 1300) / 100.0 AS sr_log_pval, (l_partkey % 40) * 1.0 AS sr_called_median, (l_orderkey % 7) * 1.0 AS sr_bg_median,
          ((l_orderkey * 11 + l_suppkey) % 1500) / 100.0 AS rd_log_pval, ((l_partkey * 13 + l_orderkey) % 100) / 100.0 AS rd_median_separation,
          ((l_orderkey * 13) % 900) / 100.0 AS rd_log_2nd_max_p,
          CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE ((l_partkey * 29 + l_orderkey) % 200) / 100.0 END AS baf_del_loglik,
          CASE WHEN l_partkey % 6 = 1 THEN NULL ELSE ((l_partkey * 31 + l_orderkey) % 1000) / 100.0 END AS baf_ks_log_pval,
          CASE (l_orderkey + l_suppkey) % 4 WHEN 0 THEN 'depth' WHEN 1 THEN 'manta' WHEN 2 THEN 'wham' ELSE 'depth,manta' END AS algorithms
        FROM lineitem""",
}


class Tables:
    """Lazy access to raw and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(FIXTURES[f"fx_{name}"])

    def sql(self, text: str) -> DataFrame:
        """Run SQL text that names raw tables or fx_ tables."""
        import re

        names = set(re.findall(r"\bfx_\w+\b", text)) | {r for r in RAW if re.search(rf"\b(FROM|JOIN)\s+{r}\b", text)}
        args, out = {}, text.replace("{", "{{").replace("}", "}}")
        for n in names:
            args[n] = getattr(self, n[3:] if n.startswith("fx_") else n)
            out = re.sub(rf"\b{n}\b", "{" + n + "}", out) if n.startswith("fx_") else re.sub(rf"\b(FROM|JOIN)\s+{n}\b", r"\1 {" + n + "}", out)
        return self.spark.sql(out, **args)
