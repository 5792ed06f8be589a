"""Partitions to start from: density, k-means and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import entropy as E
from orrery.operators.components import connected_components
from orrery.plans.scratch import materialize


def dbscan(points: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters, from the pairs (u, v) of points within reach. cluster is the smallest core id of it, null for noise.

    A core has at least min_samples points within reach, itself counted. Others within reach of cores join the cluster with the smallest core.
    """
    both = near.select(F.col("u").alias("id"), F.col("v").alias("o")).unionByName(near.select(F.col("v").alias("id"), F.col("u").alias("o")))
    n = both.groupBy("id").agg((F.count("*") + 1).alias("n"))
    core = n.where(F.col("n") >= min_samples).select("id")
    if min_samples <= 1:
        core = points.select("id")
    core = materialize(core, "dbscan")
    linked = near.join(core.withColumnRenamed("id", "u"), "u", "left_semi").join(core.withColumnRenamed("id", "v"), "v", "left_semi")
    comp = connected_components(linked.select("u", "v").unionByName(core.select(F.col("id").alias("u"), F.col("id").alias("v"))))
    border = both.join(core, "id", "left_anti").join(comp.withColumnRenamed("node", "o"), "o").groupBy("id").agg(F.min("component").alias("cluster"))
    got = comp.select(F.col("node").alias("id"), F.col("component").alias("cluster")).unionByName(border)
    return points.select("id").join(got, "id", "left")


def as_partition(clusters: DataFrame) -> DataFrame:
    """(node, cid): clusters as parts; points without one are parts of their own."""
    return clusters.select(F.col("id").alias("node"), F.coalesce("cluster", -2 - F.col("id")).alias("cid"))


def kmeans(points: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """(id, cluster): k-means with seeded parallel initialization."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = points.select("id", array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(d)
    return model.transform(d).select("id", F.col("prediction").cast("bigint").alias("cluster"))


def codelength(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(codelength), one row: bits per step of a random walk described by the two-level map equation of the partition."""
    plog = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    p = E._with_total(E.part_stats(edges, partition)).select((F.col("cut_weight") / F.col("total")).alias("q"), (F.col("vol") / F.col("total")).alias("p"))
    parts = p.agg(F.sum("q").alias("q"), F.sum(plog(F.col("q"))).alias("lq"), F.sum(plog(F.col("q") + F.col("p"))).alias("lqp"))
    d = E.degree(edges).where(F.col("degree") > 0)
    nodes = d.agg(F.sum("degree").alias("v"), F.sum(F.col("degree") * F.log2("degree")).alias("dl")).select((F.col("dl") / F.col("v") - F.log2("v")).alias("ln"))
    return parts.join(F.broadcast(nodes)).select((plog(F.col("q")) - 2 * F.col("lq") - F.col("ln") + F.col("lqp")).alias("codelength"))


def map_moves(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(node, cid, delta): for each node the neighbouring part to which moving it shortens the codelength most (equal ones: the smaller), and by how much."""
    stats = materialize(E.part_stats(edges, partition).select("cid", "vol", F.col("cut_weight").alias("cut")), "flow-stats")
    all_ = stats.agg(F.sum("vol").alias("total"), F.sum("cut").alias("cuts"))
    d = E.degree(edges).select("node", F.col("degree").alias("d"))
    e = edges.where("u <> v")
    both = e.select(F.col("u").alias("node"), F.col("v").alias("other"), "w").unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("other"), "w"))
    to = both.join(partition.select(F.col("node").alias("other"), F.col("cid").alias("to")), "other").groupBy("node", "to").agg(F.sum("w").alias("w"))
    own = to.join(partition.select("node", F.col("cid").alias("own")), "node")
    ext = own.groupBy("node").agg(F.sum("w").alias("ext"), F.coalesce(F.sum(F.when(F.col("to") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("wi"))
    x = own.where("to <> own").join(ext, "node").join(d, "node")
    x = x.join(stats.select(F.col("cid").alias("own"), F.col("vol").alias("vi"), F.col("cut").alias("ci")), "own").join(stats.select(F.col("cid").alias("to"), F.col("vol").alias("vj"), F.col("cut").alias("cj")), "to")
    x = x.join(F.broadcast(all_))
    x = x.withColumn("ci2", F.col("ci") - F.col("ext") + 2 * F.col("wi")).withColumn("cj2", F.col("cj") + F.col("ext") - 2 * F.col("w"))
    p = lambda c: F.when(c > 1e-15, c * F.log2(c)).otherwise(0.0)
    t = F.col("total")
    cuts = F.col("cuts") - F.col("ci") - F.col("cj") + F.col("ci2") + F.col("cj2")
    delta = (
        p(cuts / t) - p(F.col("cuts") / t) - 2 * (p(F.col("ci2") / t) + p(F.col("cj2") / t) - p(F.col("ci") / t) - p(F.col("cj") / t))
        + p((F.col("ci2") + F.col("vi") - F.col("d")) / t) + p((F.col("cj2") + F.col("vj") + F.col("d")) / t) - p((F.col("ci") + F.col("vi")) / t) - p((F.col("cj") + F.col("vj")) / t)
    )
    best = x.select("node", "to", delta.alias("delta")).where("delta < -1e-10").groupBy("node").agg(F.min(F.struct("delta", "to")).alias("m"))
    return best.select("node", F.col("m.to").alias("cid"), F.col("m.delta").alias("delta"))


def flow_partition(edges: DataFrame, prior: DataFrame | None = None, least: float = 1e-3) -> DataFrame:
    """(node, cid): parts between which a random walk seldom goes, by the two-level map equation. First parts merge in rounds on the contracted graph as long as that shortens
    the codelength, from the prior or from single nodes; then nodes move to the neighbouring parts that shorten it most, until a round gains less than `least` of it.

    Moves of a round are judged against the parts before it, so half of the nodes move at a time, and a round that doesn't gain as a whole is not taken. No edges: no parts.
    """
    from orrery.operators.partition import merge_rounds

    edges = materialize(edges.select("u", "v", "w"), "flow-edges")
    part, turn = materialize(merge_rounds(edges, prior, "flow").select("node", "cid"), "flow"), 0
    low, failed = codelength(edges, part).first()[0], 0
    while low is not None and failed < 2:
        moves, turn = map_moves(edges, part), turn + 1
        some = moves.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        new = part.withColumnRenamed("cid", "old").join(some.select("node", "cid"), "node", "left").select("node", F.coalesce("cid", "old").alias("cid"))
        new = materialize(new, "flow")
        now = codelength(edges, new).first()[0]
        failed = 0 if now < low * (1 - least) else failed + 1
        if now < low - 1e-12:
            part, low = new, now
    return part


def spectral(edges: DataFrame, k: int, rounds: int = 30, seed: int = 1) -> DataFrame:
    """(id, cluster): power-iteration clustering, the scalable relative of spectral clustering; edges weigh as similarities."""
    from pyspark.ml.clustering import PowerIterationClustering

    d = edges.where("u <> v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"))
    got = PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight", initMode="degree").assignClusters(d)
    return got.select("id", F.col("cluster").cast("bigint").alias("cluster"))
