"""Connected components of a link table by alternating large-star and small-star steps.

Each step joins a node's neighbours to the least of them; both are sums over keys with a combine
before the shuffle, and each pass is written to the shared folder, so lineage stays short.
"""

from pyspark.sql import functions as F

from thrustlog.session import stored_table


def _least(links):
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _both(links):
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(links):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links):
    """``links`` (u, v) of bigint; returns (node, root) for every node linked to a smaller one."""
    ordered = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored_table(ordered, "links")
    before = None
    while before != (state := _state(now)):
        before = state
        near = _both(now)
        roots = _least(near).select("u", F.least("u", "least").alias("least"))
        large = near.join(roots, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()
        large = stored_table(large, "links")
        least = _least(large)
        small = large.join(least, "u")
        hung = small.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = stored_table(hung.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
