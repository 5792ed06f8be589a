"""Partitions that decode most information: greedy merging of parts.

Spark contracts the graph to its parts: volume, cut and edges between parts. The queue algorithms are sequential by definition and work on these sums on the
driver; they refuse more than `most_parts` of them. merge_rounds() is the form for any size: in each round, parts choose their best neighbour, mutual choices merge and
those that choose one of the two join them.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.operators import entropy as E
from orrery.plans.numbering import numbered
from orrery.plans.scratch import drop_table, write_table

#: Most parts, and pairs of them with edges between, whose sums the driver holds.
MOST_PARTS, MOST_LINKS = 20_000, 2_000_000


def singletons(edges: DataFrame) -> DataFrame:
    """(node, cid): every node a part of its own, named by it."""
    n = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return n.select("node", F.col("node").alias("cid"))


class _Parts:
    """Sums of the parts of a graph, and how they change by merging."""

    def __init__(self, edges: DataFrame, partition: DataFrame, cut: str, most_parts: int):
        stats = E.part_stats(edges, partition).select("cid", "vol", F.col(f"cut_{cut}").cast("double").alias("g"))
        rows = stats.limit(most_parts + 1).collect()
        if len(rows) > most_parts:
            raise ValueError(f"more than {most_parts} parts: use merge_rounds() or give a prior partition")
        heads = partition.groupBy("cid").agg(F.min("node").alias("head")).join(stats.select("cid"), "cid")
        self.vol, self.g = {r["cid"]: r["vol"] for r in rows}, {r["cid"]: r["g"] for r in rows}
        self.near: dict = {c: {} for c in self.vol}
        links = E.between(edges, partition).select("ci", "cj", F.col(f"m_{cut}").cast("double").alias("m")).limit(MOST_LINKS + 1).collect()
        if len(links) > MOST_LINKS:
            raise ValueError(f"more than {MOST_LINKS} pairs of parts have edges between them: use merge_rounds() or give a prior partition")
        for r in links:
            self.near[r["ci"]][r["cj"]] = self.near[r["cj"]][r["ci"]] = r["m"]
        # Parts stand in the order of their nodes, which is that of their smallest ones; the nodes themselves stay in Spark.
        self.head = {c: -2 - c for c in self.vol} | {r["cid"]: r["head"] for r in heads.collect()}
        self.into = {c: c for c in self.vol}
        self.partition = partition
        self.total = sum(self.vol.values())
        self.order = sorted(self.vol, key=self.head.get)

    def merge(self, a, b) -> None:
        """b joins a."""
        m = self.near[a].pop(b, 0.0)
        self.near[b].pop(a, None)
        for c, x in self.near.pop(b).items():
            self.near[c].pop(b)
            self.near[a][c] = self.near[c][a] = self.near[a].get(c, 0.0) + x
        self.vol[a] += self.vol.pop(b)
        self.g[a] = self.g[a] + self.g.pop(b) - 2 * m
        self.head[a] = min(self.head[a], self.head.pop(b))
        self.into[b] = a

    def di(self) -> float:
        t = self.total
        return round(sum(0.0 if v / t < E.SMALL_PART else -((v - self.g[c]) / t) * math.log2(v / t) for c, v in self.vol.items()), 3)

    def delta(self, a, b, gain: str) -> float:
        vi, vj, gi, gj, m, t = self.vol[a], self.vol[b], self.g[a], self.g[b], self.near[a].get(b, 0.0), self.total
        vij, gij = vi + vj, gi + gj - 2 * m
        log = math.log2
        if gain == "di":
            one = lambda x: 1.0 if x < E.SMALL_PART else x
            s = -(vi - gi) * log(one(vi)) - (vj - gj) * log(one(vj)) + (vij - gij) * log(one(vij)) + (vi + vj - vij - gi - gj + gij) * log(one(t))
            return s / t
        if gain == "entropy":
            return -((vi - gi) * log(vi) + (vj - gj) * log(vj) - (vij - gij) * log(vij) + (gi + gj - gij) * log(t + E.TINY)) / t
        t = t + E.TINY
        rp = lambda v, g: -(v - g) / t * log(v / t + E.TINY)
        return rp(vi, gi) + rp(vj, gj) - rp(vij, gij)

    def table(self, spark) -> DataFrame:
        """(node, cid): parts numbered by their smallest nodes."""
        number = {c: k for k, c in enumerate(sorted(self.vol, key=self.head.get))}

        def last(c):
            while self.into[c] != c:
                c = self.into[c]
            return number[c]

        moved = spark.createDataFrame([(c, last(c)) for c in self.into], "old bigint, new bigint")
        return self.partition.join(moved, F.col("cid") == F.col("old")).select("node", F.col("new").alias("cid"))


def greedy_steps(edges: DataFrame, prior: DataFrame | None = None, steps: int = 100, most_parts: int = MOST_PARTS) -> tuple[DataFrame, DataFrame]:
    """The partition (node, cid) after so many steps, and the trace (iter, di) of its decoding information.

    Each step takes the part at the head of the queue, merges it with the part of least gain_di, the first of equal ones, if that is below 0, and puts it at the end.
    It stops early when one part is left. Cuts count edges.
    """
    p = _Parts(edges, prior if prior is not None else singletons(edges), "count", most_parts)
    queue, trace = list(p.order), [(0, p.di())]
    for k in range(1, steps + 1):
        if len(queue) > 1:
            a = queue.pop(0)
            gains = [p.delta(a, b, "di") for b in queue]
            low = min(gains)
            if low < 0:
                p.merge(a, queue.pop(gains.index(low)))
            queue.append(a)
        trace.append((k, p.di()))
    spark = edges.sparkSession
    return p.table(spark), spark.createDataFrame(trace, "iter int, di double")


def greedy(edges: DataFrame, gain: str = "di", prior: DataFrame | None = None, most_parts: int = MOST_PARTS) -> DataFrame:
    """(node, cid): the queue algorithm until a whole pass over the parts merges nothing. gain is 'entropy' (least two-dimensional entropy), 'rate' or 'di'.

    Of equal gains the part queued last wins.
    """
    p = _Parts(edges, prior if prior is not None else singletons(edges), E.GAINS[gain][1], most_parts)
    queue, idle = deque(p.order), 0
    while idle < len(queue) and len(queue) > 1:
        a = queue.popleft()
        best, low = None, 0.0
        for b in reversed(queue):
            d = p.delta(a, b, gain)
            if d < low:
                best, low = b, d
        if best is None:
            idle += 1
        else:
            queue.remove(best)
            p.merge(a, best)
            idle = 0
        queue.append(a)
    return p.table(edges.sparkSession)


def merge_rounds(edges: DataFrame, prior: DataFrame | None = None, gain: str = "di", max_rounds: int | None = None) -> DataFrame:
    """(node, cid): distributed greedy merging. Every part chooses the neighbour with which merging gains most (equal ones: smaller number); parts that choose each
    other merge, and those that choose one of the two join them, best first, as long as joining what has grown so far still gains and no less than their next choice.
    gain is one of entropy.GAINS or 'flow', the codelength of the map equation. Each round works on the contracted graph only; it ends when no part gains, as every round merges some. Raises if that takes more than max_rounds."""
    f, cut = (E.gain_flow, "weight") if gain == "flow" else E.GAINS[gain]
    sign = -1 if gain == "entropy" else 1
    spark, used = edges.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(write_table(df, name))
        return spark.read.schema(df.schema).parquet(used[-1])

    part = keep(prior if prior is not None else singletons(edges), "merge-part")
    stats = keep(E.part_stats(edges, part).select("cid", "vol", F.col(f"cut_{cut}").cast("double").alias("g")), "merge-stats")
    near = keep(E.between(edges, part).select("ci", "cj", F.col(f"m_{cut}").cast("double").alias("m")), "merge-near")
    total = stats.agg(F.sum("vol")).first()[0] or 1.0
    cuts: list[float] = []
    delta = lambda vi, vj, gi, gj, m: sign * f(*[F.col(c) for c in (vi, vj, gi, gj, m)], *(total, *cuts) if cuts else (F.lit(total),))
    rounds = 0
    while True:
        old = list(used)
        if gain == "flow":
            cuts[:] = [stats.agg(F.sum("g")).first()[0] or 0.0]
        a = stats.select(F.col("cid").alias("ci"), F.col("vol").alias("vi"), F.col("g").alias("gi"))
        b = stats.select(F.col("cid").alias("cj"), F.col("vol").alias("vj"), F.col("g").alias("gj"))
        cand = near.join(a, "ci").join(b, "cj").withColumn("d", delta("vi", "vj", "gi", "gj", "m")).where("d < -1e-12")
        both = cand.selectExpr("ci AS me", "cj AS you", "d", "vi AS v", "gi AS g", "m").unionByName(cand.selectExpr("cj AS me", "ci AS you", "d", "vj AS v", "gj AS g", "m"))
        both = keep(both, "merge-gains")
        pick = keep(both.groupBy("me").agg(F.min(F.struct("d", "you", "v", "g", "m")).alias("p")).select("me", "p.*"), "merge-pick")
        mutual = pick.join(pick.selectExpr("me AS you", "you AS me", "v AS vy", "g AS gy"), ["me", "you"]).where("me < you")
        mutual = mutual.select(F.col("me").alias("hub"), F.col("you").alias("mate"), (F.col("v") + F.col("vy")).alias("vh"), (F.col("g") + F.col("gy") - 2 * F.col("m")).alias("gh"))
        ends = mutual.withColumn("you", F.explode(F.array("hub", "mate")))
        more = pick.join(ends, "you").where("me <> hub AND me <> mate")
        other = both.join(more.select("me", "hub", "mate"), "me").where("you <> hub AND you <> mate").groupBy("me").agg(F.min("d").alias("second"))
        # Edges between those that join are left out here, which can only make a gain look smaller.
        w = W.partitionBy("hub").orderBy("d", "me")
        before = w.rowsBetween(W.unboundedPreceding, -1)
        more = more.join(other, "me", "left").select(
            "hub", "me", "d", "v", "g", "m", "second", (F.col("vh") + F.coalesce(F.sum("v").over(before), F.lit(0.0))).alias("vs"),
            (F.col("gh") + F.coalesce(F.sum(F.col("g") - 2 * F.col("m")).over(before), F.lit(0.0))).alias("gs"),
        ).withColumn("now", delta("vs", "v", "gs", "g", "m"))
        lost = F.sum(F.expr("if(now < -1e-12 AND now <= coalesce(second, 0), 0, 1)")).over(w.rowsBetween(W.unboundedPreceding, 0))
        joined = more.withColumn("lost", lost).where("lost = 0").select(F.col("me").alias("old"), F.col("hub").alias("new"))
        move = keep(mutual.select(F.col("mate").alias("old"), F.col("hub").alias("new")).unionByName(joined), "merge-move")
        if move.isEmpty():
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"parts still gain after {max_rounds} rounds")
        to = lambda d, c: d.join(move.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        part = keep(to(part, "cid"), "merge-part")
        inner = to(to(near, "ci"), "cj").where("ci = cj").groupBy(F.col("ci").alias("cid")).agg((2 * F.sum("m")).alias("inner"))
        stats = to(stats, "cid").groupBy("cid").agg(F.sum("vol").alias("vol"), F.sum("g").alias("g")).join(inner, "cid", "left")
        stats = keep(stats.select("cid", "vol", (F.col("g") - F.coalesce("inner", F.lit(0.0))).alias("g")), "merge-stats")
        near = to(to(near, "ci"), "cj").where("ci <> cj").groupBy(F.least("ci", "cj").alias("ci"), F.greatest("ci", "cj").alias("cj")).agg(F.sum("m").alias("m"))
        near = keep(near, "merge-near")
        for p in old:
            drop_table(spark, p)
            used.remove(p)
    return part


def labels(points: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, label): label of the part, numbered from 0 by the smallest node of each; -1 for points in none."""
    head = numbered(partition.groupBy("cid").agg(F.min("node").alias("head")), ["head"], "label").withColumn("label", F.col("label").cast("int"))
    p = partition.join(head, "cid").select(F.col("node").alias("id"), "label")
    return points.select("id").join(p, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def as_lists(partition: DataFrame) -> DataFrame:
    """(cid, nodes): the sorted nodes of each part."""
    return partition.groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
