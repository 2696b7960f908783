"""Quality rules with host verdicts: rule failures are summed by host, each host's failure rate is shrunk by a beta prior
fitted to all hosts, and the host verdicts go back to the documents. Column functions only.

``judge`` gives the verdict of the query and of the pipeline's stage: the base rules, symbol density and duplicate lines, and hosts measured
against the prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, text_of, words_of, write_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS_PERCENT = 30  # of the words
MAX_DUP_LINES_PERCENT = 30  # of the lines that aren't blank
HOST_ODDS = 4  # a refused host has so many times the odds of the mean host to fail, for sure
LEAST_HOST_RATE = 0.25
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_metrics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), the metrics of every row, and ``_failed``: any rule fails.

    A null text has no words. Metrics of an input column of the same name replace it. Windows are compared by 64-bit hash
    within one text. Every row counts for itself, repeated ones too.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in METRICS]
    t = text_of(F.col(f"`{text}`"))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("_t"), words_of(t).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    cols = [F.col(f"`{c}`") for c in keep]
    d = d.select(*cols, F.transform("_w", lambda x: F.xxhash64(x)).alias("_wh"), F.size("_w").cast("long").alias("n_words"),
                 F.char_length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
                 (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("_l"))
    last = F.greatest(F.col("n_words") - WINDOW, F.lit(0)).cast("int")
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_wh", i + k) for k in range(WINDOW)])))
    d = d.select(*cols, "n_words", "word_chars", "n_symbols", F.size("_l").alias("_n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.coalesce(windows, F.array().cast("array<bigint>")).alias("_g"))
    # most texts repeat no window: only the others are sorted
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", pairs).drop("_g")
    same = lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"])
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))).drop("_s")
    gaps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    marks = 100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words")
    return d.withColumn("_failed", F.col("base_failed") | marks | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("_n_lines"))).drop("_n_lines")


def host_verdicts(rows: DataFrame, host: str, failed: str = "_failed") -> DataFrame:
    """(_host, n_docs, n_failed, shrunk_rate, host_ok), one row per host; null hosts count as the empty host.

    The prior Beta(a, b) has the mean and variance of the hosts' rates (moments); hosts of one mind, or a single host, give
    a prior worth one document. A host is refused when its shrunk rate less two standard deviations of its posterior is above
    ``LEAST_HOST_RATE`` and has ``HOST_ODDS`` times the odds of the mean (the hosts' or the documents', whichever is less).
    """
    hosts = rows.groupBy(F.coalesce(F.col(host), F.lit("")).alias("_host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("_m"), F.var_pop(rate).alias("_v"), F.avg(rate).alias("_r"))
    strength = F.when((F.col("_v") > 0) & (F.col("_m") * (1 - F.col("_m")) > F.col("_v")), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1).otherwise(F.lit(1.0))
    prior = prior.select("_m", strength.alias("_k"), F.least("_m", "_r").alias("_r"))
    # one row of two numbers
    out = hosts.join(prior, F.lit(True), "left").withColumn("shrunk_rate", (F.col("n_failed") + F.col("_m") * F.col("_k")) / (F.col("n_docs") + F.col("_k")))
    s, n = F.col("shrunk_rate"), F.col("n_docs") + F.col("_k")
    sure = s - 2 * F.sqrt(s * (1 - s) / (n + 1))
    ok = sure <= F.greatest(F.lit(LEAST_HOST_RATE), HOST_ODDS * F.col("_r") / (1 + (HOST_ODDS - 1) * F.col("_r")))
    return out.select("_host", "n_docs", "n_failed", "shrunk_rate", ok.alias("host_ok"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, the metrics and ``kept``: all rules hold and the host is not refused. One row per input row.

    Only refused hosts go back to the rows. They are settled as a table first, so that their measured size decides whether they are
    broadcast, and the rows with their texts stay where they are.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in METRICS + ["kept"]]
    src = docs.withColumn("_hostkey", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")))
    m = write_table(quality_metrics(src, text, keep + ["_hostkey"]))
    refused = write_table(host_verdicts(m, "_hostkey").where("NOT host_ok").select(F.col("_host").alias("_hostkey"), F.lit(True).alias("_refused")))
    out = m.join(refused, "_hostkey", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], *METRICS, (~F.col("_failed") & F.col("_refused").isNull()).alias("kept"))


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns they came with."""
    if not set(METRICS + ["kept"]) & set(docs.columns):
        return judge(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return judge(renamed, at["source"], at["text"]).where("kept").select(*[F.col(v).alias(c) for c, v in at.items()])
