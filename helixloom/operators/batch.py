"""minGQ learning, batch effects, dosage matrices and mosaic screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chisq1_p, two_proportion_chisq
from ..session import cut_lineage
from .relatedness import prune_related as prune_related


def min_gq_curve(trio_rows: DataFrame, grid: list[int]) -> DataFrame:
    """Retained inherited rate and de novo rate per minimum GQ, as medians over families.

    A row is a het proband of a complete trio with ``label`` inh / dn. Rows are reduced to the
    GQ they survive up to (the proband's, or the trio's least) per family before meeting the grid.
    """
    keep = F.when(F.col("label") == "inh", F.col("pro_gq")).otherwise(F.least("pro_gq", "fa_gq", "mo_gq"))
    n = trio_rows.select("family", "label", keep.alias("g")).groupBy("family", "label", "g").agg(F.count("*").alias("n"))
    tot = n.where("label = 'inh'").groupBy("family").agg(F.sum("n").alias("_all"))
    x = n.withColumn("min_gq", F.explode(F.array(*[F.lit(v) for v in grid]))).groupBy("family", "min_gq").agg(
        F.sum(F.when((F.col("label") == "inh") & (F.col("g") > F.col("min_gq")), F.col("n")).otherwise(0)).alias("inh"),
        F.sum(F.when((F.col("label") == "dn") & (F.col("g") > F.col("min_gq")), F.col("n")).otherwise(0)).alias("dn"),
    ).join(tot, "family")
    kept = F.col("inh") + F.col("dn")
    x = x.withColumn("_ir", F.col("inh") / F.col("_all")).withColumn("_dr", F.when(kept > 0, F.col("dn") / kept))
    med = lambda c: F.percentile(c, F.lit(0.5))
    return x.groupBy("min_gq").agg(med("inh").alias("inherited"), med("_ir").alias("inherited_rate"), med("dn").alias("denovo"), med("_dr").alias("denovo_rate"))


def optimal_min_gq(curve: DataFrame, max_denovo_rate: float = 0.05) -> DataFrame:
    """Smallest GQ with an acceptable de novo rate, else the largest one that retains anything."""
    ok = F.min(F.when(F.col("denovo_rate") <= max_denovo_rate, F.col("min_gq")))
    return curve.agg(F.coalesce(ok, F.max(F.when(F.col("inherited_rate") > 0, F.col("min_gq")))).alias("min_gq"))


def condition_strata(sizes: list[tuple[int, int]], freqs: list[tuple[float, float]], types: list[str], spark) -> DataFrame:
    """All combinations of size range, frequency range and type as numbered conditions (a small table by construction)."""
    rows = [(i, lo, hi, a, b, t) for i, ((lo, hi), (a, b), t) in enumerate((s, f, t) for s in sizes for f in freqs for t in types)]
    return spark.createDataFrame(rows, "cond_id int, min_svlen long, max_svlen long, min_af double, max_af double, svtype string")


def assign_conditions(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Rows with their condition: equi-join on type, ranges as residual (the condition table is fixed and small)."""
    c = strata.select("cond_id", F.col("svtype").alias("_t"), "min_svlen", "max_svlen", "min_af", "max_af")
    cond = (F.col("svtype") == F.col("_t")) & (F.col("svlen") >= F.col("min_svlen")) & (F.col("svlen") < F.col("max_svlen")) & (F.col("af") >= F.col("min_af")) & (F.col("af") < F.col("max_af"))
    return rows.join(c, cond).drop("_t", "min_svlen", "max_svlen", "min_af", "max_af")


def min_gq_tree(per_leaf: DataFrame, layers: list[str]) -> tuple[list[str], DataFrame]:
    """Greedy layer order by the total of inherited variants retained, and inherited leaf values.

    At every step the layer whose classes together retain most (sum of each class's best) goes
    next, ties alphabetically; a leaf without its own value takes its closest set ancestor's.
    ``per_leaf`` holds one row per leaf, so the few driver decisions read one number each.
    """
    order: list[str] = []
    while len(order) < len(layers):
        rest = sorted(x for x in layers if x not in order)
        score = {}
        for x in rest:
            g = per_leaf.groupBy(*order, x).agg(F.max("retained").alias("m"))
            score[x] = g.agg(F.sum("m")).first()[0] or 0
        order.append(max(rest, key=lambda x: (score[x], -rest.index(x))))
    out = per_leaf
    for k in range(len(order) - 1, 0, -1):
        # value of the ancestor at depth k: that of its leaf retaining most
        up = per_leaf.where("min_gq IS NOT NULL").groupBy(*order[:k]).agg(F.max_by("min_gq", F.struct("retained", -F.col("min_gq"))).alias("_u"))
        out = out.join(up, order[:k], "left").withColumn("min_gq", F.coalesce("min_gq", "_u")).drop("_u")
    return order, out


def batch_frequencies(genotypes, samples) -> DataFrame:
    """AN and AC per (variant, batch, population)."""
    g = genotypes.join(samples.select("sample", "batch", "pop"), "sample")
    an = F.sum(F.col("a1").isNotNull().cast("int") + F.col("a2").isNotNull().cast("int"))
    ac = F.sum((F.coalesce("a1", F.lit(0)) > 0).cast("int") + (F.coalesce("a2", F.lit(0)) > 0).cast("int"))
    return g.groupBy("vid", "batch", "pop").agg(an.alias("an"), ac.alias("ac"))


def batch_effect_tests(freqs: DataFrame, min_an: int = 30, one_vs_all: bool = False) -> DataFrame:
    """Chi-square comparison of batch pairs (or each batch against all others) per variant.

    Of the populations with an alternate allele in either batch, the one with the largest
    smaller AN is tested if that exceeds ``min_an``; among equals the first by name.
    """
    z = F.lit(0).cast("long")
    if one_vs_all:
        tot = freqs.groupBy("vid", "pop").agg(F.sum("an").alias("_an"), F.sum("ac").alias("_ac"))
        d = freqs.join(tot, ["vid", "pop"]).select("vid", "pop", F.col("batch").alias("b1"), F.lit("ALL_OTHERS").alias("b2"), F.col("an").alias("an1"), F.col("ac").alias("ac1"), (F.col("_an") - F.col("an")).alias("an2"), (F.col("_ac") - F.col("ac")).alias("ac2"))
    else:
        a = freqs.select("vid", "pop", F.col("batch").alias("b1"), F.col("an").alias("an1"), F.col("ac").alias("ac1"))
        b = freqs.select("vid", "pop", F.col("batch").alias("b2"), F.col("an").alias("an2"), F.col("ac").alias("ac2"))
        d = a.join(b, ["vid", "pop"]).where("b1 < b2")
    d = d.withColumn("_m", F.when(F.greatest("ac1", "ac2") < 1, z).otherwise(F.least("an1", "an2"))).where(F.col("_m") > min_an)
    best = F.min_by(F.struct("pop", "an1", "ac1", "an2", "ac2"), F.struct(-F.col("_m"), F.col("pop")))
    d = d.groupBy("vid", "b1", "b2").agg(best.alias("x")).select("vid", "b1", "b2", "x.*")
    c1, c2 = F.least("ac1", "an1"), F.least("ac2", "an2")
    d = d.withColumn("af1", c1 / F.col("an1")).withColumn("af2", c2 / F.col("an2"))
    stat = two_proportion_chisq((F.col("an1") - c1).cast("double"), c1.cast("double"), (F.col("an2") - c2).cast("double"), c2.cast("double"))
    return d.withColumn("chisq", stat).withColumn("p", chisq1_p(stat)).select("vid", "b1", "b2", "pop", "af1", "af2", "chisq", "p")


def reclassify_batch_effects(fails: DataFrame, freqs: DataFrame, pairwise: int = 12, one_vs_all: int = 2, min_plus: float = 0.11) -> DataFrame:
    """Class of variants that fail enough comparisons (vid, fails/plus fraction per mode, PCR AFs)."""
    d = fails.join(freqs, "vid")
    fp, fo = F.col("fails_pairwise") >= pairwise, F.col("fails_onevsall") >= one_vs_all
    frac = F.when(fp & fo, F.greatest("plus_pairwise", "plus_onevsall")).when(fp, F.col("plus_pairwise")).when(fo, F.col("plus_onevsall"))
    cls = F.when(frac >= min_plus, F.when(F.col("pcrplus_af") >= F.col("pcrminus_af"), "PCRPLUS_ENRICHED").otherwise("PCRPLUS_DEPLETED")).otherwise("VARIABLE_ACROSS_BATCHES")
    return d.where(fp | fo).select("vid", cls.alias("classification"))


def apply_batch_labels(genotypes, samples, classes) -> DataFrame:
    """Enriched variants keep genotypes only in PCR+ samples, depleted ones only outside of them."""
    g = genotypes.join(samples.select("sample", "pcr"), "sample").join(classes, "vid", "left")
    plus = F.col("pcr") == "PCRPLUS"
    gone = F.coalesce(((F.col("classification") == "PCRPLUS_ENRICHED") & ~plus) | ((F.col("classification") == "PCRPLUS_DEPLETED") & plus), F.lit(False))
    return g.select("vid", "sample", *[F.when(~gone, F.col(a)).alias(a) for a in ("a1", "a2")])


def batch_correlation(freqs: DataFrame) -> DataFrame:
    """Correlation of allele frequencies between batches within a population."""
    f = freqs.where("an > 0").select("vid", "pop", "batch", (F.col("ac") / F.col("an")).alias("af"))
    a, b = f.withColumnsRenamed({"batch": "b1", "af": "x"}), f.withColumnsRenamed({"batch": "b2", "af": "y"})
    return a.join(b, ["vid", "pop"]).where("b1 < b2").groupBy("pop", "b1", "b2").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Frequencies before and after filtering with the chi-square of the change (vid, an, ac each)."""
    d = before.select("vid", F.col("an").alias("an1"), F.col("ac").alias("ac1")).join(after.select("vid", F.col("an").alias("an2"), F.col("ac").alias("ac2")), "vid")
    stat = two_proportion_chisq((F.col("an1") - F.col("ac1")).cast("double"), F.col("ac1").cast("double"), (F.col("an2") - F.col("ac2")).cast("double"), F.col("ac2").cast("double"))
    af = lambda k: F.when(F.col("an" + k) > 0, F.col("ac" + k) / F.col("an" + k))
    return d.select("vid", af("1").alias("af_before"), af("2").alias("af_after"), stat.alias("chisq"), chisq1_p(stat).alias("p"))


def allele_dosage(genotypes: DataFrame) -> DataFrame:
    """Long dosage matrix (vid, sample, dosage); null genotypes are left out."""
    return genotypes.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("vid", "sample", (F.col("a1") + F.col("a2")).alias("dosage"))


def dosage_components(dosage: DataFrame, k: int = 4) -> DataFrame:
    """(sample, component, value): scores of the samples on the leading principal components.

    Dosages are centred per variant over the samples that have one, so a missing dosage stands at its variant's mean. Each
    component's sign makes its largest score positive (of equal ones that of the first sample).
    """
    from .factors import principal_components, with_signs

    mean = dosage.groupBy("vid").agg(F.avg("dosage").alias("_mu"))
    centred = dosage.join(mean, "vid").select("vid", "sample", (F.col("dosage") - F.col("_mu")).alias("value")).where("value <> 0")
    return with_signs(principal_components(centred, k, row="vid", col="sample"), "sample")


def label_ancestry(components: DataFrame, training: DataFrame) -> DataFrame:
    """Ancestry of unlabelled samples by one-vs-rest linear SVMs on their components."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    v = components.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("v")).withColumn("features", array_to_vector("v"))
    v = cut_lineage(v)  # one row per sample, read by every fit
    tr = v.join(training.select("sample", "pop"), "sample")
    ix = StringIndexer(inputCol="pop", outputCol="label", stringOrderType="alphabetAsc").fit(tr)
    model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01)).fit(ix.transform(tr))
    names = F.array(*[F.lit(x) for x in ix.labels])
    return model.transform(v).select("sample", F.element_at(names, F.col("prediction").cast("int") + 1).alias("ancestry"))


def mosaic_candidates(metrics: DataFrame, min_log_p: float, min_separation: float, min_size: int = 5000, max_poor: float = 0.3) -> DataFrame:
    """Single-carrier depth variants whose p passes but whose separation is too low for a germline event,
    or lies below Q1 - 1.5 IQR of the passing ones of the type."""
    ok = metrics.where((F.col("n_carriers") == 1) & (F.col("svsize") >= min_size) & (F.col("poor_region_cov") < max_poor) & (F.col("rd_log_pval") >= min_log_p))
    q = ok.groupBy("svtype").agg(F.percentile("rd_median_separation", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    d = ok.join(q.select("svtype", (F.col("_q")[0] - 1.5 * (F.col("_q")[1] - F.col("_q")[0])).alias("_f")), "svtype")
    return d.where((F.col("rd_median_separation") < F.col("_f")) | (F.col("rd_median_separation") < min_separation)).drop("_f")


def denovo_metric_filter(child: DataFrame, parents: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """De novo calls whose child passes every cutoff and none of whose parents does.

    Both frames carry (vid, family, sample) and the metric columns; parents are reduced to the
    strongest value per metric before the join.
    """
    mx = parents.groupBy("vid", "family").agg(*[F.max(m).alias("_p_" + m) for m in cutoffs])
    d = child.join(mx, ["vid", "family"], "left")
    ok, bad = F.lit(True), F.lit(True)
    for m, c in cutoffs.items():
        ok = ok & F.coalesce(F.col(m) >= c, F.lit(False))
        bad = bad & F.coalesce(F.col("_p_" + m) >= c, F.lit(False))
    return d.withColumn("denovo_pass", ok & ~bad).drop(*["_p_" + m for m in cutoffs])


def inheritance_summary(trio_rows: DataFrame, by: list[str]) -> DataFrame:
    """Inherited and de novo variant counts and rates by class (het probands of complete trios)."""
    dn = (F.col("fa_ac") == 0) & (F.col("mo_ac") == 0)
    d = trio_rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(dn).alias("n_denovo"))
    return d.withColumn("n_inherited", F.col("n") - F.col("n_denovo")).withColumn("denovo_rate", F.col("n_denovo") / F.col("n"))


def low_quality_categories(rates: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Share of variants with a high Mendelian violation rate per (type, filter, size class)."""
    v = 1 - F.col("mendelian") / F.col("trios_considered")
    d = rates.where("trios_considered > 0").withColumn("_v", v)
    return d.groupBy("svtype", "filter", "size_class").agg(F.count("*").alias("n"), F.count_if(F.col("_v") > cutoff).alias("n_high"), (F.count_if(F.col("_v") > cutoff) / F.count("*")).alias("frac_high"))
