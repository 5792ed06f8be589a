"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import materialize

#: A node with more edges than this, and than a ten thousandth of all, is joined apart: there are at most 20,000 such nodes.
HUB = 100_000
#: Rounds after which something must be wrong: they grow with the logarithm of the longest chain.
MOST_ROUNDS = 200


def _with_least(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """both (u, v), of at most so many edges a node, with m, the least of each u (u, m, n). The rows of hubs, of which a bounded number exist, meet theirs by broadcast and are never in one task."""
    hub = max(HUB, edges // 10_000)
    if 2 * edges <= hub:
        # No node can have that many edges.
        return both.join(least.select("u", "m"), "u")
    few = both.join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return few.unionByName(both.join(F.broadcast(least.where(F.col("n") > hub).select("u", "m")), "u"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the smallest node of it. Nodes without edges to others don't appear unless they have a self-loop.

    Each round links the larger neighbours of every node to the smallest one, then its smaller neighbours likewise, until every node
    hangs on its smallest: the rounds grow with the logarithm of the longest chain. Minima are partial aggregates and hubs are joined apart, so no node's edges come
    together in one task. Edges with a null end are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = materialize(e.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct().select("u", "v"), "components")
    last, n = None, 0
    for _ in range(MOST_ROUNDS):
        n = n or e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, n).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, n = now, now[0]
    else:
        raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    linked = nodes.unionByName(roots)
    return linked.unionByName(loops.join(linked, "node", "left_anti").withColumn("component", F.col("node")))
