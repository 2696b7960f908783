"""Licence scan: a trained classifier of paragraphs over sparse word n-grams.

A multinomial logistic regression is trained on the templates' words, with words left out and corpus words around them, against
corpus paragraphs and sentences that use licence words otherwise (class ``unknown``). The probability that a
family needs is calibrated on the other corpus paragraphs; a prediction is confirmed by comparing the paragraph's
n-grams with the family's templates. Paragraphs that name a licence in any wording are in neither half. Column functions and Spark ML only.

Every distinct corpus paragraph counts, half of them (by their hash) for training and half for calibration. Paragraphs are the same example when the
same features are in them, so the regression and the quantile work on distinct feature sets and their numbers. A paragraph
without any selected word has no feature, hence the prediction of the empty text, so scoring starts from the join of all words with the selected ones.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, settle
from .common import text_of

UNKNOWN = "unknown"
CORPUS_WEIGHT = 1500  # examples of the templates that the training paragraphs weigh as much as, at most
QUANTILE = 0.998  # of the calibration's paragraphs, below the needed probability
LEAST_P = 0.5
CONFIRM = 0.6
# fixed values: usual wordings of notices, by family
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL", "SPDX-License-Identifier: MPL-2.0"),
    ("proprietary", "Copyright 2020 Example Inc. All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
# fixed values: licence words in other use
OTHER = [
    "His driving license was taken away after the third offence.", "The committee licensed two new clinics in the city.", "She studied physics at MIT and at Apache Junction.",
    "The general public was not admitted.", "Version 2.0 of the report was released last week under pressure.", "All rights of the tenants were respected.", "Permission to land was granted.",
    "A license to fish costs ten dollars.", "The source of the river is in a binary star atlas.", "She is the author of this work and holds a copy of the file.",
]


# fixed values: words of the templates that are no licence words, however often the corpus has them
ORDINARY = set("a all and any are as associated at author by charge code conditions copy copying example except extent file files following for form forms free general has http in inc international is it "
               "later law library may met not of on only or org person possible published related released source subject terms that the this to under universal use v version via with without work www you".split())
# fixed values: words of notices alone, and names that are a notice's beside a form of "license"
SURE = ["agpl", "cc0", "copyright", "copyrighted", "gpl", "gplv0", "lgpl", "lgplv0", "mpl", "spdx"]
NAMES = ["apache", "bsd", "cc", "commons", "contributor", "gnu", "isc", "mit", "mozilla", "public"]


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, every digit a 0."""
    return F.filter(F.split(F.translate(F.lower(text), "123456789", "000000000"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(words, pairs))


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, paragraph, line): the lines of each text that aren't blank, numbered from 0 with the blank ones."""
    lines = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(text_of(F.col(f"`{text}`")), "\n")).alias("paragraph", "line"))
    return lines.where(F.trim("line") != "")


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, t, i) for i, (f, t) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "family string, line string, template int").withColumn("_w", tokens(F.col("line")))


def _examples(spark: SparkSession) -> DataFrame:
    """(family, _w): templates, templates short of each word in turn, and sentences of the unknown class."""
    t = _template_rows(spark)
    whole = t.select("family", "_w")
    left = t.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.concat(F.slice("_w", F.lit(1), i - 1), F.slice("_w", i + 1, F.size("_w"))))).alias("_w"))
    other = spark.createDataFrame([(s,) for s in OTHER], "line string").select(F.lit(UNKNOWN).alias("family"), tokens(F.col("line")).alias("_w"))
    return whole.unionByName(left).unionByName(other)


def _names_licence(words: Column, specific: list[str]) -> Column:
    """A word of notices alone, a pair of licence words from a template, or a form of "license" beside a licence's name."""
    has = lambda some: F.exists(words, lambda w: w.isin(*some))
    parts = sorted({w for pair in specific for w in pair.split()})
    beside = has(NAMES) & F.exists(words, lambda w: w.rlike("^(un|re|sub)?licen[cs]"))
    return has(SURE) | beside | (has(parts) & F.exists(grams(words), lambda g: g.isin(*specific)))


def _samples(lines: DataFrame, bit: int = 4) -> tuple[DataFrame, DataFrame]:
    """All corpus paragraphs that name no licence, (line, _w, _h), in two halves by a bit of their hash _h: for training and for calibration."""
    pairs = {r["_g"] for r in _template_rows(lines.sparkSession).select(F.explode(grams(F.col("_w"))).alias("_g")).distinct().collect()}  # bounded by the templates
    specific = sorted(g for g in pairs if " " in g and not any(w in ORDINARY or len(w) < 2 for w in g.split()))
    # as a generator's output the words are made once, while a filter on an alias is pushed below it and makes them for each mention
    found = lines.select("line", F.xxhash64("line").alias("_h"), F.explode(F.array(tokens(F.col("line")))).alias("_w")).where(~_names_licence(F.col("_w"), specific))
    odd = F.pmod(F.shiftright("_h", bit), F.lit(2))
    return found.where(odd == 0), found.where(odd == 1)


def _feature_sets(spark: SparkSession, lines: DataFrame, features: list[str]) -> DataFrame:
    """(use, family, features, n): how many distinct corpus paragraphs have which features. ``use`` is 0 for training paragraphs, 1 for the words around a
    template in their middle, and 2 for calibration. A paragraph leaves its partition as a hash and its features."""
    templates = [(r["family"], r["_w"]) for r in _template_rows(spark).orderBy("template").collect()]  # bounded by the templates
    single = [g for g in features if " " not in g]

    def found(words):
        return F.array_sort(F.array_distinct(F.filter(grams(words), lambda g: g.isin(*features))))

    none = F.array().cast("array<string>")
    of = lambda use, family, f: F.struct(F.lit(use).alias("use"), family.alias("family"), f.alias("features"))
    at = (F.abs(F.xxhash64("line")) % len(templates) + 1).cast("int")
    middle = F.element_at(F.array(*[F.array(*map(F.lit, w)) for _, w in templates]), at)
    around = of(1, F.element_at(F.array(*[F.lit(f) for f, _ in templates]), at), found(F.col("_m")))
    # a pair that is a feature has a selected word
    own = lambda use: of(use, F.lit(UNKNOWN), F.when(F.exists("_w", lambda w: w.isin(*single)), found(F.col("_w"))).otherwise(none))
    train, held = _samples(lines)
    train = train.withColumn("_m", F.concat(F.slice("_w", 1, 8), middle, F.slice("_w", 9, 8)))
    rows = train.select("_h", F.array(own(0), around).alias("_x")).unionByName(held.select("_h", F.array(own(2)).alias("_x")))
    return settle(rows.distinct().select(F.inline_outer("_x"))  # no array is empty: the outer form has no filter to push down
                  .groupBy("use", "family", "features").agg(F.count("*").alias("n")))


def fit(lines: DataFrame, corpus_weight: int = CORPUS_WEIGHT) -> tuple[DataFrame, list[str], dict[str, float], float]:
    """(gram, family, w) weights, the selected single words, the families' intercepts, and the probability a family needs.

    Training paragraphs share the weight ``corpus_weight`` if there are more of them than that. With no corpus paragraphs the classifier is trained on
    the fixed sentences alone and needs ``LEAST_P``.
    """
    spark = lines.sparkSession
    in_templates = _template_rows(spark).select(F.explode(grams(F.col("_w"))).alias("gram")).distinct()
    # a pair counts if one of its words is selected; single digits select nothing
    names = sorted(r["gram"] for r in in_templates.collect())  # bounded by the templates
    words = {g for g in names if " " not in g and g not in ORDINARY and not g.isdigit() and len(g) > 1}
    features = sorted(g for g in names if g in words or " " in g and set(g.split()) & words)
    labels = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    at = F.create_map(*[x for i, f in enumerate(labels) for x in (F.lit(f), F.lit(float(i)))])
    space = F.array(*[F.lit(g) for g in features])
    sets = _feature_sets(spark, lines, features)
    total = sets.where("use = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sets")).first()
    each = min(1.0, corpus_weight / max(total["n"], 1))
    fixed = _examples(spark).select("family", grams(F.col("_w")).alias("_g"), F.lit(1.0).alias("weight"))
    corpus = sets.where("use < 2").select("family", F.col("features").alias("_g"), (F.col("n") * each).alias("weight"))
    vector = array_to_vector(F.transform(space, lambda f: F.array_contains("_g", f).cast("double")))
    rows = fixed.unionByName(corpus).select(F.element_at(at, F.col("family")).alias("label"), vector.alias("features"), "weight").repartition(4 + total["sets"] // 5000)
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.003, weightCol="weight").fit(rows)
    m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = spark.createDataFrame([(g, labels[k], float(m[k, j])) for j, g in enumerate(features) for k in range(len(labels))], "gram string, family string, w double")
    bias = {f: float(x) for f, x in zip(labels, b)}
    held = sets.where("use = 2").select("features", "n")
    p = _families(held.select(F.col("features").alias("line"), F.explode("features").alias("gram")), weights, bias).groupBy(F.col("line").alias("features")).agg(F.max("p").alias("p"))
    # lines without a feature are in the quantile too; equal probabilities differ in the order of their sums
    most = held.join(p, "features", "left").agg(F.percentile(F.coalesce("p", F.lit(0.0)), QUANTILE, F.col("n"))).first()[0]
    return weights, sorted(words), bias, min(0.99, max(LEAST_P, (most or 0.0) - 1e-9))


def _families(found: DataFrame, weights: DataFrame, bias: dict[str, float]) -> DataFrame:
    """(line, family, p, top) for each line of ``found`` (line, gram) that has a feature, and each family."""
    table = F.broadcast(weights.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("family", "w"))).alias("ws")))  # bounded by the templates
    names = sorted(bias)
    g = found.join(table, "gram")
    sums = g.groupBy("line").agg(*[F.sum(F.col("ws")[k]["w"]).alias(f"z{k}") for k in range(len(names))])
    at = {f: F.col(f"z{k}") + bias[f] for k, f in enumerate(names)}
    z = F.array(*[F.struct(x.alias("z"), F.lit(f).alias("family")) for f, x in at.items() if f != UNKNOWN])
    each = sums.select("line", at[UNKNOWN].alias("_u"), z.alias("_z")).select("line", "_u", F.array_max("_z").alias("_best"), F.explode("_z").alias("_x"))
    return each.select("line", F.col("_x.family").alias("family"), (1 / (1 + F.exp(F.col("_u") - F.col("_x.z")))).alias("p"), (F.col("_x") == F.col("_best")).alias("top"))


def predict(lines: DataFrame, weights: DataFrame, bias: dict[str, float], least: float = LEAST_P) -> DataFrame:
    """(line, family, p, top): each distinct line with its families of at least ``least``; p is the family's probability against ``unknown``
    alone, so that two families of one line don't share it; ``top`` marks the likeliest family."""
    found = lines.select("line").distinct().select("line", F.explode(grams(tokens(F.col("line")))).alias("gram"))
    return _families(found, weights, bias).where(F.col("p") >= least)


def _template_grams(spark: SparkSession) -> DataFrame:
    """(_f, _t, _own): family, n-grams and the n-grams that no other family's template has, for each template."""
    t = _template_rows(spark).select(F.col("family").alias("_f"), grams(F.col("_w")).alias("_t"))
    own = t.select("_f", F.explode("_t").alias("g")).groupBy("g").agg(F.count_distinct("_f").alias("n")).where("n = 1").agg(F.collect_set("g").alias("_all"))
    return t.join(own, F.lit(True)).select("_f", "_t", F.array_intersect("_t", "_all").alias("_own"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", corpus_weight: int = CORPUS_WEIGHT) -> DataFrame:
    """(doc_id, paragraph, line, family, p, template_share, confirmed), a row for each family of a paragraph; ``confirmed`` if a template
    of the family has at least ``CONFIRM`` of its n-grams in it. Families other than the likeliest one need that confirmation, by the n-grams of
    their own too.

    Null and empty texts have no paragraph. Rows repeated with the same id and text are reported once. Lines found in many documents are judged once.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text)
    weights, words, bias, needed = fit(lines, corpus_weight)
    chosen = F.broadcast(spark.createDataFrame([(w,) for w in words], "word string"))  # bounded by the templates
    held = lines.select("doc_id", "paragraph", "line", F.explode(tokens(F.col("line"))).alias("word")).join(chosen, "word", "left_semi")
    held = cut_lineage(held.select("doc_id", "paragraph", "line").distinct())
    p = predict(held.select("line"), weights, bias, needed)
    t = F.broadcast(_template_grams(spark))
    p = p.withColumn("_g", grams(tokens(F.col("line")))).join(t, F.col("family") == F.col("_f"))
    share, own = F.size(F.array_intersect("_g", "_t")) / F.size("_t"), F.size(F.array_intersect("_g", "_own")) / F.size("_own")
    best = p.groupBy("line", "family", "p", "top").agg(F.max(share).alias("template_share"), F.max((share >= CONFIRM) & (own >= CONFIRM)).alias("_sure")).where("top OR _sure")
    return held.join(best, "line").select("doc_id", "paragraph", "line", "family", "p", "template_share", (F.col("template_share") >= CONFIRM).alias("confirmed"))
