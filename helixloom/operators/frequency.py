"""Allele and copy-number frequencies from the long genotype table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: contigs with sex-dependent ploidy
SEX_CONTIGS = ["X", "Y", "chrX", "chrY"]


def _allele_counts():
    known = F.col("a1").isNotNull().cast("int") + F.col("a2").isNotNull().cast("int")
    alt = (F.coalesce("a1", F.lit(0)) > 0).cast("int") + (F.coalesce("a2", F.lit(0)) > 0).cast("int")
    full = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    return [
        F.sum(known).alias("an"), F.sum(alt).alias("ac"),
        F.count_if(full & (alt == 0)).alias("n_homref"), F.count_if(full & (alt == 1)).alias("n_het"), F.count_if(alt == 2).alias("n_homalt"),
    ]


def _with_frequencies(d: DataFrame) -> DataFrame:
    n = F.col("n_homref") + F.col("n_het") + F.col("n_homalt")
    d = d.withColumn("af", F.when(F.col("an") > 0, F.round(F.col("ac") / F.col("an"), 6)).otherwise(F.lit(0.0))).withColumn("n_bi_genos", n)
    return d.withColumns({f"freq_{g}": F.when(n > 0, F.col(f"n_{g}") / n).otherwise(F.lit(0.0)) for g in ("homref", "het", "homalt")})


def allele_frequencies(genotypes: DataFrame, by=("vid",)) -> DataFrame:
    """AN, AC, AF and genotype counts; a null allele counts neither as AN nor AC."""
    return _with_frequencies(genotypes.groupBy(*by).agg(*_allele_counts()))


def stratified_frequencies(genotypes, sites, samples, par: DataFrame | None = None) -> DataFrame:
    """Frequencies for all samples, by sex, by population and by both ('ALL' marks a total).

    The rows are first reduced to one per (variant, population, sex); only that small result
    goes through GROUPING SETS, so the fourfold expansion never touches genotypes. Off the
    pseudo-autosomal regions males are hemizygous on X and Y: AN is halved and AC counts
    non-reference genotypes; totals there add the male and the female numbers.
    """
    s = sites.select("vid", "chrom", *([] if par is None else ["pos", "stop"]))
    hemi = F.col("chrom").isin(SEX_CONTIGS)
    if par is not None:
        from .intervals import overlap_semi

        iv = s.where(hemi).select("vid", "chrom", F.least("pos", "stop").alias("start"), F.greatest("pos", "stop").alias("stop"))
        inside = overlap_semi(iv, par, ["vid"]).select("vid").withColumn("_par", F.lit(True))
        s = s.join(inside, "vid", "left")
        hemi = hemi & F.col("_par").isNull()
    s = s.select("vid", hemi.alias("_hemi"))
    fine = genotypes.join(samples.select("sample", "pop", "sex"), "sample").groupBy("vid", "pop", "sex").agg(*_allele_counts())
    fine = fine.join(s, "vid")
    male = F.col("_hemi") & (F.col("sex") == "MALE")
    fine = fine.withColumn("ac", F.when(male, F.col("n_het") + F.col("n_homalt")).otherwise(F.col("ac")))
    fine = fine.withColumn("an", F.when(male, F.col("an") / 2).otherwise(F.col("an").cast("double")))
    counted = ~F.col("_hemi") | F.col("sex").isin("MALE", "FEMALE")
    sums = [F.sum(F.when(counted, F.col(c)).otherwise(0)).alias(c) for c in ("an", "ac")]
    sums += [F.sum(c).alias(c) for c in ("n_homref", "n_het", "n_homalt")]
    vid, pop, sex = F.col("vid"), F.col("pop"), F.col("sex")
    g = fine.groupingSets([[vid], [vid, sex], [vid, pop], [vid, pop, sex]], vid, pop, sex).agg(
        *sums, F.grouping("pop").alias("_gp"), F.grouping("sex").alias("_gs")
    )
    g = g.withColumn("pop", F.when(F.col("_gp") == 1, "ALL").otherwise(pop)).withColumn("sex", F.when(F.col("_gs") == 1, "ALL").otherwise(sex))
    return _with_frequencies(g.drop("_gp", "_gs"))


def popmax(strata: DataFrame) -> DataFrame:
    """Highest population AF per variant."""
    return strata.where("pop <> 'ALL' AND sex = 'ALL'").groupBy("vid").agg(F.max("af").alias("popmax_af"))


def copy_number_distribution(genotypes: DataFrame, ref_cn: int = 2, cn: str = "rd_cn") -> DataFrame:
    """Samples per copy state 0..max, their frequencies, and the non-reference count."""
    n = genotypes.where(F.col(cn).isNotNull()).groupBy("vid", cn).agg(F.count("*").alias("n"))
    d = n.groupBy("vid").agg(
        F.map_from_entries(F.collect_list(F.struct(cn, "n"))).alias("_m"), F.max(cn).alias("_max"), F.sum("n").alias("cn_number"),
        F.sum(F.when(F.col(cn) != ref_cn, F.col("n")).otherwise(0)).alias("cn_nonref_count"),
    )
    d = d.withColumn("_d", F.transform(F.sequence(F.lit(0), F.col("_max")), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0))))
    return d.select(
        "vid", "cn_number", F.array_join(F.col("_d").cast("array<string>"), ",").alias("cn_count"),
        F.transform("_d", lambda x: F.round(x / F.col("cn_number"), 6)).alias("cn_freq"),
        "cn_nonref_count", F.round(F.col("cn_nonref_count") / F.col("cn_number"), 6).alias("cn_nonref_freq"),
    )
