"""Connected components by alternating large-star / small-star rounds, then pointer jumping.

Every round is two equi-joins and two map-side combined aggregations, and the edge set
never grows, so a hub holding a large share of all edges is only a skewed join key (split
by AQE), never a group collected in one task. Lineage is cut by tables in the checkpoint folder, whose measured sizes plan the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = d.groupBy("u").agg(F.min("v").alias("m"))
    links = d.join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_forest(e: DataFrame) -> bool:
    """Every node has one parent. Parents are smaller and rounds keep connectivity, so each
    tree is a whole component with its smallest node as the root."""
    return e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0


def _jump_to_roots(e: DataFrame) -> DataFrame:
    """Pointer jumping: halves the depth of every tree per round."""
    while True:
        up = e.select(F.col("u").alias("v"), F.col("v").alias("w")).hint("merge")
        j = settle(e.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")))
        e = j.select("u", "v")
        if j.where("moved").limit(1).count() == 0:
            return e


def _encode(e: DataFrame):
    """Replace node ids by order-preserving longs: nodes are range partitioned, sorted and numbered."""
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = settle(nodes.repartitionByRange(n, "node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))
    a, b = nodes.select(F.col("node").alias("u"), F.col("id").alias("_u")), nodes.select(F.col("node").alias("v"), F.col("id").alias("_v"))
    e = e.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v"))
    return settle(e), nodes


def connected_components(edges: DataFrame, src="u", dst="v") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e, nodes = _encode(e)
    before = None
    while True:
        n = e.count()
        # the uniqueness test is a shuffle: only worth it once the edge set has stopped shrinking
        if n == 0 or (before is not None and n > 0.99 * before and _is_forest(e)):
            break
        before = n
        e = settle(_small_star(_large_star(e)))
    e = _jump_to_roots(e)
    roots = e.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    label = nodes.select(F.col("id").alias("v"), F.col("node").alias("component"))
    return e.unionByName(roots).join(nodes.withColumnRenamed("id", "u"), "u").join(label, "v").select("node", "component")


def label_components(nodes: DataFrame, edges: DataFrame, key: str, src="u", dst="v", name="component") -> DataFrame:
    """``nodes`` with a component column; a node without an edge is its own component."""
    cc = connected_components(edges, src, dst).withColumnsRenamed({"node": key, "component": name})
    return nodes.join(cc, key, "left").withColumn(name, F.coalesce(name, key))
