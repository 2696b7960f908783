"""Binned coverage counted on a stream of alignments (the batch form is operators.coverage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bin_counts(alignments: DataFrame, width: int = 100, event_time: str = "ts", delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Reads per (time window, contig, bin, sample); late rows beyond ``delay`` are dropped."""
    d = alignments.where(~F.col("duplicate") & ~F.col("secondary") & F.col("mapped")).withWatermark(event_time, delay)
    bins = F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor((F.col("stop") - 1) / width).cast("long"))
    return d.withColumn("bin", F.explode(bins)).groupBy(F.window(event_time, every), "chrom", "bin", "sample").agg(F.count("*").alias("cov"))
