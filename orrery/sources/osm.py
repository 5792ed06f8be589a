"""Road files: nodes and ways, segments, junction graphs and closed rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.plans.numbering import numbered
from orrery.plans.scratch import materialize

NODE = "_id BIGINT, _lon DOUBLE, _lat DOUBLE"
WAY = "_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)


def way_segments(ways: DataFrame) -> DataFrame:
    """(way, pos, a, b): consecutive nodes of each way; entries without a reference are passed over. Ways of fewer than two nodes have none."""
    refs = F.filter(F.transform("nd", lambda n: n["_ref"]), lambda r: r.isNotNull())
    s = ways.select(F.col("_id").alias("way"), refs.alias("r")).where(F.size("r") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(F.get("r", i - 1).alias("a"), F.get("r", i).alias("b")))
    return s.select("way", F.posexplode(pairs).alias("pos", "p")).select("way", F.col("pos").cast("bigint").alias("pos"), "p.a", "p.b")


def road_graph(ways: DataFrame) -> DataFrame:
    """(u, v, w): the simple undirected graph of all ways, w = 1. A node next to itself is no edge."""
    return way_segments(ways).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("w", F.lit(1.0))


def simplify(edges: DataFrame) -> DataFrame:
    """(u, v, n): the graph without nodes of degree two: chains of them become one edge of n steps. Rings without any other node go; of parallel chains between
    the same ends each counts once by its length."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    inner = materialize(both.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") == 2).select("u"), "chains")
    e = edges.join(inner.withColumn("iu", F.lit(1)), "u", "left").join(inner.select(F.col("u").alias("v"), F.lit(1).alias("iv")), "v", "left")
    plain = e.where("iu IS NULL AND iv IS NULL").select("u", "v", F.lit(1).cast("bigint").alias("n"))
    comp = materialize(connected_components(e.where("iu = 1 AND iv = 1").select("u", "v").unionByName(inner.select("u", F.col("u").alias("v")))), "chains")
    side = e.where("(iu IS NULL) <> (iv IS NULL)").select(F.when(F.col("iu").isNull(), F.col("u")).otherwise(F.col("v")).alias("end"), F.when(F.col("iu") == 1, F.col("u")).otherwise(F.col("v")).alias("node"))
    ends = side.join(comp, "node").groupBy("component").agg(F.min("end").alias("u"), F.max("end").alias("v"), F.count("*").alias("k"))
    size = comp.groupBy("component").agg(F.count("*").alias("c"))
    chains = ends.join(size, "component").where("u <> v").select("u", "v", (F.col("c") + 1).alias("n"))
    return plain.unionByName(chains).distinct()


def relabel(edges: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, map): nodes renumbered from 0 in the order given as (node, first). Numbers are dealt per range of the order, so no task sorts all."""
    o = order.groupBy("node").agg(F.min("first").alias("first"))
    m = numbered(o, ["first", "node"], "label").select("node", "label")
    e = edges.join(m.select(F.col("node").alias("u"), F.col("label").alias("nu")), "u").join(m.select(F.col("node").alias("v"), F.col("label").alias("nv")), "v")
    return e.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "w"), m


def ring_order(segments: DataFrame, max_steps: int = 100_000) -> DataFrame:
    """(seq, node): the closed line that head-to-tail segments (a, b) make, from the first segment's start. A gap ends it: the ring is then what was reached.

    A ring is one line; it is followed on the driver, within max_steps segments.
    """
    rows = segments.select("a", "b").limit(max_steps + 1).collect()
    if len(rows) > max_steps:
        raise ValueError(f"more than {max_steps} segments")
    near: dict = {}
    for k, r in enumerate(rows):
        near.setdefault(r["a"], []).append((k, r["b"]))
        near.setdefault(r["b"], []).append((k, r["a"]))
    out, used = [], set()
    at = rows[0]["a"] if rows else None
    while at is not None:
        out.append(at)
        step = next(((k, n) for k, n in near[at] if k not in used), None)
        if step is None:
            break
        used.add(step[0])
        at = step[1]
        if at == out[0]:
            out.append(at)
            break
    return segments.sparkSession.createDataFrame(list(enumerate(out)), "seq int, node bigint")


def ring_lines(segments: DataFrame) -> DataFrame:
    """(line, ord, node): closed lines in the order of their head-to-tail segments (line, a, b), each from its smallest node; the first node is not repeated at the end.

    Lists are ranked by doubling: each node learns how far ahead its pointer reaches, and the rounds grow with the logarithm of the longest line. So lines may be many and
    long. Segments with a null end or of no length are ignored, repeated ones count once. A node with several segments onward goes on with the one to the smallest node;
    where a line has a gap, what lies on the way to the gap counts back from it and comes first, and its smallest node is no start.
    """
    e = segments.where("line IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy("line", "a").agg(F.min("b").alias("b"))
    start = e.groupBy("line").agg(F.min("a").alias("s"))
    # The pointer of the node before the start is cut; every other node points ahead.
    p = e.join(start, "line").select("line", F.col("a").alias("node"), F.when(F.col("b") != F.col("s"), F.col("b")).alias("to")).withColumn("ahead", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("bigint"))
    p = materialize(p, "ring-pointers")
    n = p.groupBy("line").agg(F.count("*").alias("n"))
    longest, reach = n.agg(F.max("n")).first()[0] or 0, 1
    while reach < longest:
        q = p.select("line", F.col("node").alias("to"), F.col("to").alias("next"), F.col("ahead").alias("more"))
        p = materialize(p.join(q, ["line", "to"], "left").select("line", "node", F.col("next").alias("to"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "ring-pointers")
        reach *= 2
    return p.join(n, "line").select("line", (F.col("n") - 1 - F.col("ahead")).alias("ord"), "node")
