"""Structural entropy, decoding information and the sizes that they are made of, as aggregates of edge tables.

Edges are (u, v, w), undirected, each once; a self-loop counts twice in its node's degree. A partition is (node, cid). `cut` says whether the edges that
leave a part count by number ('count') or weight ('weight'). Logarithms are to base 2. No edges: no rows, or a single row of zeros or nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import materialize

TINY, SMALL_PART = 1e-10, 1e-5


def clean_edges(df: DataFrame, u: str = "u", v: str = "v", w: str = "w", key: str | None = None, order: str = "loaded_at") -> DataFrame:
    """(u, v, w), u <= v, each once: weights of parallel edges add up. Rows with a null end or a weight that isn't finite and positive are no edges; of rows with the
    same key the latest counts."""
    if key:
        from orrery.sources.tables import in_force

        df = in_force(df, key, order)
    ok = (F.col(w) > 0) & ~F.isnan(w) & (F.col(w) != float("inf"))
    d = df.where(F.col(u).isNotNull() & F.col(v).isNotNull() & ok).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col(w).alias("w"))
    return d.groupBy("u", "v").agg(F.sum("w").alias("w"))


def plog(p: Column) -> Column:
    """p log2 p, 0 for p below 1e-10."""
    return F.when(p < TINY, 0.0).otherwise(p * F.log2(p))


def degree(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(node, degree)."""
    w = F.col("w") if weighted else F.lit(1.0)
    return edges.select(F.explode(F.array("u", "v")).alias("node"), w.alias("w")).groupBy("node").agg(F.sum("w").alias("degree"))


def volume(edges: DataFrame) -> DataFrame:
    return edges.agg((2 * F.coalesce(F.sum("w"), F.lit(0.0))).alias("volume"))


def sizes(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, avg_degree), one row."""
    n = degree(edges, False).agg(F.count("*").alias("n_nodes"), (F.coalesce(F.sum("degree"), F.lit(0.0)) / 2).cast("bigint").alias("n_edges"))
    return n.select("n_nodes", "n_edges", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes")).alias("avg_degree"))


def entropy_1d(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(h1), one row. In one pass over degrees: log2 V - sum(d log2 d) / V; terms below 1e-10 of V, which count as 0 by definition, are under 4e-9 each here."""
    d = degree(edges, weighted).where(F.col("degree") > 0)
    return d.agg((F.log2(F.sum("degree")) - F.sum(F.col("degree") * F.log2("degree")) / F.sum("degree")).alias("h1"))


def entropy_1d_terms(edges: DataFrame) -> DataFrame:
    """(node, term): what each node adds to the one-dimensional entropy, -p log2 p by plog()."""
    d = degree(edges)
    return d.join(F.broadcast(d.agg(F.sum("degree").alias("total")))).select("node", (-plog(F.col("degree") / F.col("total"))).alias("term"))


def ends(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(cid, other, w): each edge from both of its ends. Nodes without a part are parts of their own, numbered below -1."""
    p = partition.select("node", "cid")
    e = edges.join(p.withColumnsRenamed({"node": "u", "cid": "cu"}), "u", "left").join(p.withColumnsRenamed({"node": "v", "cid": "cv"}), "v", "left")
    e = e.select(F.coalesce("cu", -2 - F.col("u")).alias("cu"), F.coalesce("cv", -2 - F.col("v")).alias("cv"), "w")
    return e.select(F.explode(F.array(F.struct(F.col("cu").alias("cid"), F.col("cv").alias("other"), "w"), F.struct(F.col("cv").alias("cid"), F.col("cu").alias("other"), "w"))).alias("e")).select("e.*")


def part_stats(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(cid, vol, cut_count, cut_weight): volume of each part and the edges that leave it."""
    out = F.col("cid") != F.col("other")
    return ends(edges, partition).groupBy("cid").agg(F.sum("w").alias("vol"), F.sum(F.when(out, 1).otherwise(0)).alias("cut_count"), F.sum(F.when(out, F.col("w")).otherwise(0.0)).alias("cut_weight"))


def between(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, m_count, m_weight), ci < cj: edges between each two parts that have any."""
    e = ends(edges, partition).where("cid < other")
    return e.groupBy(F.col("cid").alias("ci"), F.col("other").alias("cj")).agg(F.count("*").alias("m_count"), F.sum("w").alias("m_weight"))


def _cut(cut: str) -> str:
    return {"count": "cut_count", "weight": "cut_weight"}[cut]


def _with_total(parts: DataFrame) -> DataFrame:
    """parts with the volume of the graph, from the parts themselves, which are made once."""
    parts = materialize(parts, "parts")
    return parts.join(F.broadcast(parts.agg(F.sum("vol").alias("total"))))


def entropy_2d(edges: DataFrame, partition: DataFrame, cut: str = "weight") -> DataFrame:
    """(h1, h2, di), one row: one- and two-dimensional entropy and what the partition decodes of it."""
    parts = part_stats(edges, partition).agg(
        F.sum("vol").alias("total"), F.sum(F.col("vol") * F.log2("vol")).alias("pv"), F.sum(_cut(cut)).alias("g"), F.sum(F.col(_cut(cut)) * F.log2("vol")).alias("gv"),
    )
    nodes = degree(edges).where(F.col("degree") > 0).agg(F.sum(F.col("degree") * F.log2("degree")).alias("dv"))
    x = parts.join(F.broadcast(nodes))
    h1 = F.log2("total") - F.col("dv") / F.col("total")
    h2 = (F.col("pv") - F.col("dv") - F.col("gv") + F.col("g") * F.log2("total")) / F.col("total")
    return x.select(h1.alias("h1"), h2.alias("h2"), (h1 - h2).alias("di"))


def entropy_1d_partition(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(h1), one row: the grouped form of the one-dimensional entropy, within parts plus between them."""
    parts = part_stats(edges, partition).agg(F.sum("vol").alias("total"), F.sum(F.col("vol") * F.log2("vol")).alias("pv"))
    nodes = degree(edges).where(F.col("degree") > 0).agg(F.sum(F.col("degree") * F.log2("degree")).alias("dv"))
    within = (F.col("pv") - F.col("dv")) / F.col("total")
    return parts.join(F.broadcast(nodes)).select((within + F.log2("total") - F.col("pv") / F.col("total")).alias("h1"))


def part_di(edges: DataFrame, partition: DataFrame, cut: str = "count") -> DataFrame:
    """(cid, di): decoding information of each part; 0 for parts below 1e-5 of the volume."""
    p = F.col("vol") / F.col("total")
    di = -((F.col("vol") - F.col(_cut(cut))) / F.col("total")) * F.log2(p)
    return _with_total(part_stats(edges, partition)).select("cid", F.when(p < SMALL_PART, 0.0).otherwise(di).alias("di"))


def total_di(edges: DataFrame, partition: DataFrame, cut: str = "count") -> DataFrame:
    """(di), rounded to 3 digits, one row."""
    return part_di(edges, partition, cut).agg(F.round(F.sum("di"), 3).alias("di"))


def di_rate(edges: DataFrame, partition: DataFrame, cut: str = "weight") -> DataFrame:
    """(di_rate), one row: decoding information by one-dimensional entropy; null where that is 0."""
    return entropy_2d(edges, partition, cut).select(F.when(F.col("h1") != 0, F.col("di") / F.col("h1")).alias("di_rate"))


def gain_di(vi, vj, gi, gj, m, total):
    """Change of decoding information by keeping two parts apart; negative where merging them gains. Volumes below 1e-5 count as 1. Columns or numbers via the given log."""
    one = lambda c: F.when(c < SMALL_PART, 1.0).otherwise(c)
    vij, gij = vi + vj, gi + gj - 2 * m
    s = -(vi - gi) * F.log2(one(vi)) - (vj - gj) * F.log2(one(vj)) + (vij - gij) * F.log2(one(vij)) + (vi + vj - vij - gi - gj + gij) * F.log2(one(total))
    return s / total


def gain_entropy(vi, vj, gi, gj, m, total):
    """Loss of two-dimensional entropy by merging two parts: positive where merging pays."""
    vij, gij = vi + vj, gi + gj - 2 * m
    s = (vi - gi) * F.log2(vi) + (vj - gj) * F.log2(vj) - (vij - gij) * F.log2(vij) + (gi + gj - gij) * F.log2(total + TINY)
    return s / total


def gain_rate(vi, vj, gi, gj, m, total):
    """The same gain from the parts' own terms: negative where merging pays."""
    t = total + TINY
    rp = lambda v, g: -(v - g) / t * F.log2(v / t + TINY)
    return rp(vi, gi) + rp(vj, gj) - rp(vi + vj, gi + gj - 2 * m)


def gain_flow(vi, vj, gi, gj, m, total, cuts):
    """Change of the two-level map equation's codelength by merging two parts, where all parts' cuts add up to `cuts`: negative where merging pays."""
    p = lambda c: F.when(c > 1e-15, c * F.log2(c)).otherwise(0.0)
    t, gij = F.lit(total), gi + gj - 2 * m
    s = -2 * (p(gij / t) - p(gi / t) - p(gj / t)) + p((gij + vi + vj) / t) - p((gi + vi) / t) - p((gj + vj) / t)
    return s + p((F.lit(cuts) - 2 * m) / t) - p(F.lit(cuts) / t)


GAINS = {"di": (gain_di, "count"), "entropy": (gain_entropy, "weight"), "rate": (gain_rate, "weight")}


def pair_gains(edges: DataFrame, partition: DataFrame, gain: str = "di", adjacent_only: bool = False) -> DataFrame:
    """(ci, cj, delta), ci < cj: gain of each two parts; adjacent_only leaves out pairs without an edge between them, of which there are far more in large graphs."""
    f, cut = GAINS[gain]
    parts = _with_total(part_stats(edges, partition)).select("cid", "vol", F.col(_cut(cut)).alias("g"), "total")
    m = between(edges, partition).select("ci", "cj", F.col(f"m_{cut}").alias("m"))
    a = parts.withColumnsRenamed({"cid": "ci", "vol": "vi", "g": "gi"})
    b = parts.select(F.col("cid").alias("cj"), F.col("vol").alias("vj"), F.col("g").alias("gj"))
    p = m.join(a, "ci").join(b, "cj") if adjacent_only else a.join(b, F.col("ci") < F.col("cj")).join(m, ["ci", "cj"], "left").fillna(0, ["m"])
    return p.select("ci", "cj", f(*[F.col(c) for c in ("vi", "vj", "gi", "gj", "m", "total")]).alias("delta"))


def pair_stats(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, vi, vj, vij, gi, gj, gij) of each two parts with an edge between them; cuts are counts."""
    parts = part_stats(edges, partition)
    a = parts.select(F.col("cid").alias("ci"), F.col("vol").alias("vi"), F.col("cut_count").alias("gi"))
    b = parts.select(F.col("cid").alias("cj"), F.col("vol").alias("vj"), F.col("cut_count").alias("gj"))
    p = between(edges, partition).join(a, "ci").join(b, "cj")
    return p.select("ci", "cj", "vi", "vj", (F.col("vi") + F.col("vj")).alias("vij"), "gi", "gj", (F.col("gi") + F.col("gj") - 2 * F.col("m_count")).alias("gij"))


def edge_gains(edges: DataFrame) -> DataFrame:
    """(u, v, delta): gain of merging the two ends of each edge as single nodes, rounded to 3 digits. Self-loops have none."""
    d = edges.select(F.explode(F.array("u", "v")).alias("node"), "w", (F.col("u") != F.col("v")).alias("out"))
    d = d.groupBy("node").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("out"), 1).otherwise(0)).alias("g"))
    e = edges.where("u <> v").join(d.select(F.col("node").alias("u"), F.col("d").alias("vi"), F.col("g").alias("gi")), "u")
    e = e.join(d.select(F.col("node").alias("v"), F.col("d").alias("vj"), F.col("g").alias("gj")), "v").join(F.broadcast(volume(edges).select(F.col("volume").alias("total"))))
    return e.select("u", "v", F.round(gain_di(F.col("vi"), F.col("vj"), F.col("gi"), F.col("gj"), F.lit(1), F.col("total")), 3).alias("delta"))


def cut_size(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(cid, cut_size): weight of the edges that leave each part."""
    return part_stats(edges, partition).select("cid", F.col("cut_weight").alias("cut_size"))
