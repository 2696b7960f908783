"""Joins whose exploded side must not be broadcast."""

from helixloom.llm import simhash


def test_exploded_block_sets_are_never_broadcast(spark):
    """A fingerprint becomes 35 rows (and hundreds in large sets), which size estimates don't know."""
    df = spark.range(50).selectExpr("xxhash64(id) AS fp")
    plan = simhash.near_links(df, bucket=3)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "Inner" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]
