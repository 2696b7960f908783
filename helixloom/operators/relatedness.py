"""Relationship labels of sample pairs from kinship metrics, and pruning of related samples."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import connected_components

METRICS = ["het_het", "ibs0", "het_conc", "hom_ibs0", "kinship", "ibd1_seg", "ibd2_seg", "prop_ibd"]
IN_ONE_TASK = 100_000  # pairs of a group of relatives that one task prunes


def known_relationships(trios: DataFrame, siblings: DataFrame | None = None, unrelated: DataFrame | None = None) -> DataFrame:
    """(a, b, truth) with a < b: parents and child, both parents (taken as unrelated), given siblings and given unrelated pairs.
    A pair with several labels keeps the closest one."""
    def pairs(d, x, y, label, rank):
        return d.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.struct(F.lit(rank).alias("r"), F.lit(label).alias("truth")).alias("_l")).where("a <> b")

    out = pairs(trios, "proband", "father", "parent_child", 0).unionByName(pairs(trios, "proband", "mother", "parent_child", 0)).unionByName(pairs(trios, "father", "mother", "unrelated", 2))
    if siblings is not None:
        out = out.unionByName(pairs(siblings, "a", "b", "siblings", 1))
    if unrelated is not None:
        out = out.unionByName(pairs(unrelated, "a", "b", "unrelated", 2))
    return out.groupBy("a", "b").agg(F.min("_l").alias("_l")).select("a", "b", "_l.truth")


def label_relationships(pairs: DataFrame, truth: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(a, b, truth, inferred): every pair's class by one-vs-rest linear classifiers on standardised metrics, trained on the pairs
    with a known relationship. Pairs with a missing metric get no label."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    metrics = metrics or METRICS
    low_first = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *metrics)
    d = settle(low_first.join(truth, ["a", "b"], "left"))
    whole = d.dropna(subset=metrics)
    ready = VectorAssembler(inputCols=metrics, outputCol="_raw").transform(whole)
    known = ready.where("truth IS NOT NULL")
    names = [r[0] for r in known.select("truth").distinct().orderBy("truth").collect()]  # a handful of classes
    if len(names) < 2:
        only = F.lit(names[0]) if names else F.lit(None).cast("string")
        return d.select("a", "b", "truth", F.when(d[metrics[0]].isNotNull(), only).alias("inferred"))
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(known)
    index = StringIndexer(inputCol="truth", outputCol="label", stringOrderType="alphabetAsc").fit(known)
    model = OneVsRest(classifier=LinearSVC(maxIter=30, regParam=1e-3)).fit(index.transform(scaler.transform(known)))
    label = F.element_at(F.array(*[F.lit(x) for x in index.labels]), F.col("prediction").cast("int") + 1)
    found = model.transform(scaler.transform(ready)).select("a", "b", "truth", label.alias("inferred"))
    return found.unionByName(d.where(F.expr(" OR ".join(f"{m} IS NULL" for m in metrics))).select("a", "b", "truth", F.lit(None).cast("string").alias("inferred")))


def relationship_accuracy(labelled: DataFrame) -> DataFrame:
    """Sensitivity, false discoveries and counts per relationship, and for all related classes together."""
    rel = ["parent_child", "siblings"]
    classes = {"unrelated": ["unrelated"], "all_related": rel, "parent_child": ["parent_child"], "siblings": ["siblings"]}
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("relationship"), F.col("truth").isin(c).alias("t"), F.coalesce(F.col("inferred").isin(c), F.lit(False)).alias("i")) for n, c in classes.items()]))
    d = labelled.select(rows.alias("x")).select("x.*")
    t, i = F.coalesce(F.col("t"), F.lit(False)), F.col("i")
    known, kept, other = F.count_if(t), F.count_if(t & i), F.count_if(F.col("t") == F.lit(False))
    return d.groupBy("relationship").agg(
        F.when(known > 0, kept / known).alias("sensitivity"), F.when(other > 0, F.count_if((F.col("t") == F.lit(False)) & i) / other).alias("false_discovery"),
        known.alias("n_known"), kept.alias("n_kept"), (F.count_if(i) - kept).alias("n_new"))


def _prune_group(pairs: pd.DataFrame) -> pd.DataFrame:
    """Ordered removal within one group: the sample with most remaining relatives goes, the first by name on ties."""
    near: dict[str, set[str]] = {}
    for a, b in pairs[["a", "b"]].itertuples(index=False):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    heap = [(-len(v), k) for k, v in near.items()]
    heapq.heapify(heap)
    gone = []
    while heap:
        n, k = heapq.heappop(heap)
        if -n != len(near[k]):
            continue  # an entry from before a relative went
        if not n:
            break
        gone.append(k)
        for x in near.pop(k):
            near[x].discard(k)
            heapq.heappush(heap, (-len(near[x]), x))
        near[k] = set()
    return pd.DataFrame({"sample": pd.Series(gone, dtype=object)})


def prune_related(pairs: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Samples to drop so that no related pair is left: the one with most relatives goes first (ties by name).

    Groups of relatives don't affect each other. A group of up to ``in_one_task`` pairs is pruned in order by one task. Of larger groups, every round removes all samples
    that come before each of their relatives in that order, which is what the ordered removal does with them, until the groups fall apart.
    """
    e = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    out = None
    while not e.isEmpty():
        label = connected_components(e, "a", "b").withColumnsRenamed({"node": "a", "component": "grp"})
        e = settle(e.join(label, "a"))
        size = e.groupBy("grp").agg(F.count("*").alias("n"))
        small = e.join(size.where(F.col("n") <= in_one_task), "grp", "left_semi")
        gone = small.select("grp", "a", "b").groupBy("grp").applyInPandas(lambda p: _prune_group(p), "sample string")
        e = settle(e.join(size.where(F.col("n") > in_one_task), "grp", "left_semi").select("a", "b"))
        for _ in range(8):
            if e.isEmpty():
                break
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            deg = both.groupBy("a").agg(F.count("*").alias("d"))
            other = deg.withColumnsRenamed({"a": "b", "d": "db"})
            first = both.join(deg, "a").join(other, "b").groupBy("a").agg(F.bool_and((F.col("d") > F.col("db")) | ((F.col("d") == F.col("db")) & (F.col("a") < F.col("b")))).alias("t"))
            first = settle(first.where("t").select(F.col("a").alias("sample")))
            gone = gone.unionByName(first)
            e = settle(e.join(first.withColumnRenamed("sample", "a"), "a", "left_anti").join(first.withColumnRenamed("sample", "b"), "b", "left_anti"))
        out = gone if out is None else out.unionByName(gone)
    return out if out is not None else e.select(F.col("a").alias("sample"))
