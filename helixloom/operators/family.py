"""Trio joins, transmission classes and de novo candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trios(ped: DataFrame) -> DataFrame:
    """Children with both parents present in the pedigree's own sample list."""
    ids = ped.select("sample")
    t = ped.where("father IS NOT NULL AND mother IS NOT NULL").select("family", F.col("sample").alias("proband"), "father", "mother")
    t = t.join(ids.withColumnRenamed("sample", "father"), "father", "left_semi")
    return t.join(ids.withColumnRenamed("sample", "mother"), "mother", "left_semi")


def clean_pedigree(ped: DataFrame, present: DataFrame) -> DataFrame:
    """Families among the present samples: TRIO_n when both parents are there, DUO_n with one.

    Numbering runs over children only, so the ordered window is bounded by the cohort.
    """
    from pyspark.sql import Window

    p = present.select("sample").distinct()
    kids = ped.join(p, "sample", "left_semi").where("father IS NOT NULL OR mother IS NOT NULL")
    kids = kids.join(p.select(F.col("sample").alias("father"), F.lit(1).alias("_f")), "father", "left")
    kids = kids.join(p.select(F.col("sample").alias("mother"), F.lit(1).alias("_m")), "mother", "left")
    kind = F.when(F.col("_f").isNotNull() & F.col("_m").isNotNull(), "TRIO").when(F.coalesce("_f", "_m").isNotNull(), "DUO")
    kids = kids.withColumn("_k", kind).where("_k IS NOT NULL")
    rn = F.row_number().over(Window.partitionBy("_k").orderBy("family", "sample"))
    return kids.select(
        F.concat_ws("_", "_k", rn.cast("string")).alias("family"), F.col("sample").alias("proband"),
        F.when(F.col("_f").isNotNull(), F.col("father")).alias("father"), F.when(F.col("_m").isNotNull(), F.col("mother")).alias("mother"), "sex",
    )


def trio_genotypes(genotypes: DataFrame, trio: DataFrame, fields=("gq",)) -> DataFrame:
    """One row per (variant, trio) with pro_/fa_/mo_ allele counts and fields.

    The genotypes join a sample -> (trio, role) map once and are folded by one shuffle on
    (vid, proband) instead of three joins of the genotype table with itself.
    """
    roles = trio.select("proband", F.inline(F.array(
        F.struct(F.col("proband").alias("sample"), F.lit("pro").alias("role")),
        F.struct(F.col("father").alias("sample"), F.lit("fa").alias("role")),
        F.struct(F.col("mother").alias("sample"), F.lit("mo").alias("role")))))
    ac = F.when(F.col("a1").isNotNull() & F.col("a2").isNotNull(), F.col("a1") + F.col("a2"))
    g = genotypes.select("vid", "sample", ac.alias("ac"), *fields).join(roles, "sample")
    aggs = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("pro", "fa", "mo") for c in ("ac", *fields)]
    return g.groupBy("vid", "proband").agg(*aggs)


def transmission_class():
    """Class of a complete trio from its three allele counts; null counts are INCOMPLETE."""
    p, f, m = F.col("pro_ac"), F.col("fa_ac"), F.col("mo_ac")
    return (
        F.when(p.isNull() | f.isNull() | m.isNull(), "INCOMPLETE")
        .when((p == 0) & (f == 0) & (m == 0), "NO_VARIANT")
        .when((p == 2) & (f == 0) & (m == 0), "APPARENT_DE_NOVO")
        .when((p == 0) & ((f == 2) | (m == 2)), "UNTRANSMITTED_HOMOZYGOTE")
        .when((p == 2) & ((f == 0) | (m == 0)), "SPONTANEOUS_HOMOZYGOTE")
        .otherwise("MENDELIAN")
    )


def mendelian_counts(genotypes, trio, samples) -> DataFrame:
    """Transmission class counts per variant and the proband's library type.

    A trio without complete genotype rows counts as incomplete.
    """
    t = trio.join(samples.select(F.col("sample").alias("proband"), "pcr"), "proband")
    total = t.groupBy("pcr").agg(F.count("*").alias("_all"))
    c = trio_genotypes(genotypes, trio, ()).withColumn("cls", transmission_class()).join(t.select("proband", "pcr"), "proband")
    names = ["NO_VARIANT", "APPARENT_DE_NOVO", "UNTRANSMITTED_HOMOZYGOTE", "SPONTANEOUS_HOMOZYGOTE", "MENDELIAN"]
    d = c.groupBy("vid", "pcr").agg(*[F.count_if(F.col("cls") == n).alias(n.lower()) for n in names])
    done = sum((F.col(n.lower()) for n in names), F.lit(0))
    d = d.join(total, "pcr").withColumn("incomplete", F.col("_all") - done).drop("_all")
    return d.withColumn("trios_considered", done - F.col("no_variant"))


def genotype_quality_summary(genotypes, samples, levels=(0.0025, 0.005, 0.0075)) -> DataFrame:
    """Counts and GQ order statistics by library type and reference / non-reference.

    The default levels are fractions of one percent: the original tool passes 0.25, 0.5 and
    0.75 to a function that expects percents, and its tables hold those values.
    """
    ac = F.when(F.col("a1").isNotNull() & F.col("a2").isNotNull(), F.col("a1") + F.col("a2"))
    g = genotypes.join(samples.select("sample", "pcr"), "sample").withColumn("state", F.when(ac.isNull(), "NULL").when(ac == 0, "REF").otherwise("NONREF"))
    q = [F.floor(F.percentile("gq", F.lit(x))).cast("long").alias(n) for n, x in zip(("q1_gq", "median_gq", "q3_gq"), levels)]
    return g.groupBy("vid", "pcr", "state").agg(F.count("*").alias("n"), F.min("gq").alias("min_gq"), *q, F.max("gq").alias("max_gq"))


def trio_table(genotypes, trio, sites) -> DataFrame:
    """Complete trios whose proband is heterozygous, with site annotations."""
    g = trio_genotypes(genotypes, trio, ("gq", "ev")).where("pro_ac = 1 AND fa_ac IS NOT NULL AND mo_ac IS NOT NULL")
    return g.join(sites, "vid")


def denovo_candidates(carriers, trio, max_parent_carriers: int = 10) -> DataFrame:
    """Child carriers whose parents do not carry the variant, rare among all parents."""
    kids = carriers.join(trio.select(F.col("proband").alias("sample"), "father", "mother"), "sample")
    for parent in ("father", "mother"):
        kids = kids.join(carriers.select("vid", F.col("sample").alias(parent)), ["vid", parent], "left_anti")
    parents = trio.select(F.explode(F.array("father", "mother")).alias("sample")).distinct()
    n = carriers.join(parents, "sample", "left_semi").groupBy("vid").agg(F.count("*").alias("n_parents"))
    out = kids.join(n, "vid", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)).cast("long"))
    return out.where(F.col("n_parents") <= max_parent_carriers).select("vid", "sample", "n_parents")
