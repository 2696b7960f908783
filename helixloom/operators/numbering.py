"""Ordinal numbers over large groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """row_number() over (by, order) through a range partitioning.

    Rows are range partitioned on (by, order), which balances any hot group, and the layout
    is checkpointed so that it cannot change between the count and the numbering. A partition
    numbers its own rows; the offset of earlier partitions is a running sum over one row per
    (partition, group).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.repartitionByRange(n, *by, *order).withColumn("_pid", F.spark_partition_id()))
    part = d.groupBy(*by, "_pid").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select(*by, "_pid", before.alias("_off"))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*order)))
    return d.join(part, [*by, "_pid"]).withColumn(name, F.col("_rn") + F.col("_off")).drop("_pid", "_rn", "_off")


def shard_rows(df: DataFrame, by: list[str], order: list[str], size: int, name: str = "shard") -> DataFrame:
    """Consecutive shards of ``size`` rows in position order."""
    return number_rows(df, by, order, "_n").withColumn(name, F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
