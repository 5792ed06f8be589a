"""Dynamics on graphs, graphs reconstructed from time series, and distances between graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.numbering import numbered
from orrery.plans.scratch import materialize

#: Nodes of the graphs that one simulation or spectrum takes as a dense matrix.
MOST_NODES = 5_000


def ring_of_cliques(spark: SparkSession, cliques: int = 6, size: int = 5) -> DataFrame:
    """(u, v, w): cliques in a ring, each linked by its second node to the first of the next."""
    i = spark.range(cliques).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("a"))
    inner = i.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).where("a < b").select((F.col("c") * size + F.col("a")).alias("u"), (F.col("c") * size + F.col("b")).alias("v"))
    link = spark.range(cliques).select((F.col("id") * size + 1).alias("p"), (F.pmod(F.col("id") + 1, F.lit(cliques)) * size).alias("q")).select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
    return inner.unionByName(link).withColumn("w", F.lit(1.0))


def grid_graph(spark: SparkSession, rows: int = 6, columns: int = 5) -> DataFrame:
    """(u, v, w): a grid with nodes numbered row by row."""
    n = spark.range(rows * columns).select(F.col("id").alias("u"))
    right = n.where((F.col("u") % columns) < columns - 1).select("u", (F.col("u") + 1).alias("v"))
    down = n.where(F.col("u") < (rows - 1) * columns).select("u", (F.col("u") + columns).alias("v"))
    return right.unionByName(down).withColumn("w", F.lit(1.0))


def preferential_graph(spark: SparkSession, n: int = 30, seed: int = 1) -> DataFrame:
    """(u, v, w): a tree in which each new node joins an old one with a chance by its degree. Sequential by definition, so made on the driver, up to MOST_NODES."""
    if n > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} nodes")
    rng, ends, edges = np.random.default_rng(seed), [0], []
    for k in range(1, n):
        o = ends[rng.integers(len(ends))]
        edges.append((int(o), k, 1.0))
        ends += [o, k]
    return spark.createDataFrame(edges, "u bigint, v bigint, w double")


def _matrix(d: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(d[["u", "v"]].to_numpy())
    if len(ids) > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} nodes")
    a = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, d["u"]), np.searchsorted(ids, d["v"])
    a[i, j] = a[j, i] = d["w"] if "w" in d else 1.0
    return ids, a


def simulate(edges: DataFrame, model: str, length: int = 2001, seed: int = 1) -> DataFrame:
    """(graph, model, node, x ARRAY<DOUBLE>): the series of each node of each graph (edges with a column `graph`), in parallel over graphs.

    model: 'branching' (each active neighbour passes on its activity with chance 1/degree, or a node starts by itself with 0.01), 'ising' (heat-bath spins at the field of
    their neighbours) or 'spin_glass' (the same with normal couplings).
    """
    def run(d: pd.DataFrame) -> pd.DataFrame:
        ids, a = _matrix(d)
        n = len(ids)
        rng = np.random.default_rng([seed, int(d["graph"].iloc[0])])
        deg = np.maximum((a > 0).sum(1), 1)
        out = np.zeros((n, length))
        if model == "branching":
            s = (rng.random(n) < 0.1).astype(float)
            for t in range(length):
                out[:, t] = s
                quiet = np.prod(1 - (a > 0) * (s / deg)[None, :], axis=1) * 0.99
                s = (rng.random(n) > quiet).astype(float)
        elif model in ("ising", "spin_glass"):
            j = (a > 0).astype(float)
            if model == "spin_glass":
                g = rng.normal(size=(n, n)) / np.sqrt(n)
                j = j * np.triu(g, 1)
                j = j + j.T
            s = np.where(rng.random(n) < 0.5, 1.0, -1.0)
            for t in range(length):
                out[:, t] = s
                s = np.where(rng.random(n) < 1 / (1 + np.exp(-2 * (j @ s) / 2)), 1.0, -1.0)
        else:
            raise ValueError(f"no such model: {model}")
        return pd.DataFrame({"graph": d["graph"].iloc[0], "model": model, "node": ids, "x": list(out)})

    return edges.groupBy("graph").applyInPandas(run, "graph bigint, model string, node bigint, x array<double>")


def series(ts: DataFrame) -> DataFrame:
    """(node, t, value) as (id, x): one vector per node, in the order of t."""
    return ts.groupBy(F.col("node").alias("id")).agg(F.expr("transform(sort_array(collect_list(struct(t, value))), s -> s.value)").alias("x"))


def by_degree(weights: DataFrame, nodes: int, degree: float) -> DataFrame:
    """(u, v, w): the pairs of largest absolute weight, as many as give this average degree; equal ones, to twelve digits: smaller ends first."""
    from orrery.operators.graphs import SURE_DIGITS

    n = max(0, round(nodes * degree / 2))
    ranked = numbered(weights.withColumn("_size", F.round(F.abs("w"), SURE_DIGITS)), [F.desc("_size"), "u", "v"], "_rank")
    return ranked.where(F.col("_rank") < n).drop("_size", "_rank")


def correlations(points: DataFrame) -> DataFrame:
    """(u, v, w): correlation of each two series."""
    from orrery.operators.graphs import pairs

    return pairs(points, "pearson_r").select("u", "v", F.col("d").alias("w"))


def correlated_by_degree(points: DataFrame, degree: float) -> DataFrame:
    """by_degree() of the correlations of all series: all pairs are compared, but only strong ones leave their block."""
    from orrery.operators.graphs import strongest_pairs

    p = materialize(points.where("id IS NOT NULL"), "series")
    n = p.count()
    return by_degree(strongest_pairs(p, "pearson_r", max(0, round(n * degree / 2))).select("u", "v", F.col("d").alias("w")), n, degree)


def _binned(x: np.ndarray, bins: int) -> np.ndarray:
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    w = np.where(hi > lo, (hi - lo) / bins, 1.0)
    return np.clip(np.floor((x - lo) / w), 0, bins - 1).astype(int)


def mutual_information(points: DataFrame, bins: int = 4) -> DataFrame:
    """(u, v, w): mutual information in bits of each two series, cut into equal bins of their own range."""
    from orrery.operators.graphs import pairs

    def metric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = _binned(a, bins), _binned(b, bins)
        n = a.shape[1]
        out = np.zeros((len(a), len(b)))
        plog = lambda c: np.where(c > 0, c * np.log2(np.where(c > 0, c, 1)), 0)
        for s in range(bins):
            fa = (p == s).astype(float)
            for t in range(bins):
                out += plog(fa @ (q == t).astype(float).T / n)
        h = lambda y: sum(plog((y == s).sum(1) / n) for s in range(bins))
        return out - h(p)[:, None] - h(q)[None, :]

    return pairs(points, metric).select("u", "v", F.col("d").alias("w"))


def partial_correlations(points: DataFrame, shrink: float = 0.1) -> DataFrame:
    """(u, v, w): correlation of each two series given all others, from the inverse of the shrunk covariance: direct links only. Series or times, the fewer
    of the two, may be MOST_NODES.

    With a = shrink times the mean variance, b = (1 - shrink) / (times - 1) and the centred series as rows of Z, the inverse of a I + b Z Z' is
    (I - b Z (a I + b Z' Z)^-1 Z') / a: where series are more than times only a matrix of times by times is inverted, and the pairs come block by block.
    """
    from orrery.operators.graphs import pairs

    spark = points.sparkSession
    p = materialize(points.where("id IS NOT NULL").select("id", F.col("x").cast("array<double>").alias("x")), "partial-points")
    n, times = p.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or times < 2:
        return spark.createDataFrame([], "u bigint, v bigint, w double")
    if min(n, times) > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} series or times")

    def dense(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        c = np.cov(np.stack(d["x"].to_numpy())).reshape(len(d), len(d))
        k = np.linalg.inv((1 - shrink) * c + shrink * np.eye(len(c)) * max(np.trace(c) / len(c), 1e-12))
        i, j = np.triu_indices(len(d), 1)
        ids = d["id"].to_numpy()
        return pd.DataFrame({"u": ids[i], "v": ids[j], "w": (-k / np.sqrt(np.outer(np.diag(k), np.diag(k))))[i, j]})

    if n <= times:
        return p.groupBy(F.lit(0).alias("all")).applyInPandas(dense, "u bigint, v bigint, w double")
    if shrink <= 0:
        raise ValueError("the covariance of more series than times has no inverse without shrinking")

    def centred(d: pd.DataFrame) -> np.ndarray:
        x = np.stack(d["x"].to_numpy()).astype(float)
        return x - x.mean(1, keepdims=True)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((times, times))
        for d in batches:
            if len(d):
                z = centred(d)
                g += z.T @ z
        yield pd.DataFrame({"i": np.arange(times), "row": list(g)})

    def added(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": d["i"].iloc[:1], "row": [np.sum(np.stack(d["row"].to_numpy()), axis=0)]})

    rows = p.mapInPandas(products, "i bigint, row array<double>").groupBy("i").applyInPandas(added, "i bigint, row array<double>")
    g = np.array([r["row"] for r in rows.orderBy("i").collect()])
    a, b = shrink * max(np.trace(g) / (times - 1) / n, 1e-12), (1 - shrink) / (times - 1)
    half = spark.sparkContext.broadcast(np.linalg.inv(np.linalg.cholesky(a * np.eye(times) + b * g)).T * np.sqrt(b))

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                y = centred(d) @ half.value
                yield pd.DataFrame({"id": d["id"], "x": list(y / np.sqrt(1 - (y * y).sum(1, keepdims=True)))})

    directions = materialize(p.mapInPandas(scaled, "id bigint, x array<double>"), "partial-scaled")
    return pairs(directions, lambda q, r: q @ r.T).select("u", "v", F.col("d").alias("w"))


def ising_likelihood(points: DataFrame, steps: int = 300, rate: float = 0.3) -> DataFrame:
    """(u, v, w): couplings of binary series by maximum likelihood of each next state given the present one, averaged over both directions."""
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        if len(d) > MOST_NODES:
            raise ValueError(f"at most {MOST_NODES} series")
        x = np.stack(d["x"].to_numpy())
        s = np.where(x > x.mean(1, keepdims=True), 1.0, -1.0)
        now, then = s[:, :-1], s[:, 1:]
        j = np.zeros((len(s), len(s)))
        for _ in range(steps):
            j += rate * ((then - np.tanh(j @ now)) @ now.T) / now.shape[1]
        j = (j + j.T) / 2
        i, k = np.triu_indices(len(s), 1)
        ids = d["id"].to_numpy()
        return pd.DataFrame({"u": ids[i], "v": ids[k], "w": j[i, k]})

    return points.groupBy(F.lit(0).alias("all")).applyInPandas(lambda d: run(d), "u bigint, v bigint, w double")


def reciprocal(arcs: DataFrame) -> DataFrame:
    """(u, v), u < v: pairs with arcs both ways."""
    a = arcs.select("u", "v").distinct()
    return a.join(a.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u < v")


def hamming(a: DataFrame, b: DataFrame, nodes: int) -> DataFrame:
    """(hamming), one row: share of the possible edges that only one of two graphs has."""
    j = a.select("u", "v", F.lit(1).alias("a")).join(b.select("u", "v", F.lit(1).alias("b")), ["u", "v"], "full")
    return j.agg((F.coalesce(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0)), F.lit(0)) / F.lit(nodes * (nodes - 1) / 2)).alias("hamming"))


def spectral_distance(a: DataFrame, b: DataFrame, nodes: int, width: float = 0.08) -> DataFrame:
    """(hamming, spectral, combined), one row: Hamming distance, difference of the Lorentz-smoothed Laplacian spectra, and the root mean square of both."""
    both = a.select(F.lit(0).alias("g"), "u", "v").unionByName(b.select(F.lit(1).alias("g"), "u", "v"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        if nodes > MOST_NODES:
            raise ValueError(f"at most {MOST_NODES} nodes")
        grid = np.linspace(0, np.sqrt(2 * nodes) + 5, 4000)
        step = grid[1] - grid[0]
        ids = np.unique(d[["u", "v"]].to_numpy())
        dens, mats = [], []
        for g in (0, 1):
            e = d[d["g"] == g]
            m = np.zeros((nodes, nodes))
            i, j = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
            m[i, j] = m[j, i] = 1
            om = np.sqrt(np.maximum(np.linalg.eigvalsh(np.diag(m.sum(1)) - m)[1:], 0))
            f = (width / ((grid[:, None] - om[None]) ** 2 + width**2)).sum(1)
            dens.append(f / (f.sum() * step))
            mats.append(m)
        im = float(np.sqrt(((dens[0] - dens[1]) ** 2).sum() * step))
        h = float(np.abs(mats[0] - mats[1]).sum() / (nodes * (nodes - 1)))
        return pd.DataFrame({"hamming": [h], "spectral": [im], "combined": [float(np.sqrt((h * h + im * im) / 2))]})

    return both.groupBy(F.lit(0).alias("all")).applyInPandas(lambda d: run(d), "hamming double, spectral double, combined double")


def gray_levels(edges: DataFrame, segments: int = 1) -> DataFrame:
    """(u, v, gray INT): weights scaled to 0..255 and cut down to multiples of `segments`, as cells of an adjacency image."""
    r = edges.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    g = F.coalesce(F.floor(F.try_divide(F.col("w") - F.col("lo"), F.col("hi") - F.col("lo")) * 255), F.lit(0))
    return edges.join(F.broadcast(r)).select("u", "v", (F.floor(g / segments) * segments).cast("int").alias("gray"))


def lagged(ts: DataFrame) -> DataFrame:
    """(node, t, value, before): each value with the one before it."""
    return ts.withColumn("before", F.lag("value").over(W.partitionBy("node").orderBy("t")))


def gray_colors(gray: DataFrame, breaks: dict[int, str]) -> DataFrame:
    """(u, v, gray, color): the color of the largest break not above each gray level, null below all."""
    color = F.lit(None).cast("string")
    for at, name in sorted(breaks.items()):
        color = F.when(F.col("gray") >= at, name).otherwise(color)
    return gray.select("u", "v", "gray", color.alias("color"))


def compare_graphs(true: DataFrame, others: dict[str, DataFrame], nodes: int) -> DataFrame:
    """(name, metric, value): decoding information of the best partition of each graph, and its distances from the true one. All weights count as 1."""
    from orrery.operators import entropy
    from orrery.operators.partition import greedy

    def plain(e: DataFrame) -> DataFrame:
        return e.select("u", "v").distinct().withColumn("w", F.lit(1.0))

    out: DataFrame | None = None
    for name, e in {"true": true, **others}.items():
        e = plain(e)
        di = entropy.entropy_2d(e, greedy(e, "rate")).select(F.lit(name).alias("name"), F.lit("di").alias("metric"), F.col("di").alias("value"))
        rows = [di] if out is None else [di, spectral_distance(plain(true), e, nodes).select(F.lit(name).alias("name"), F.explode(F.array(F.struct(F.lit("hamming").alias("metric"), F.col("hamming").alias("value")), F.struct(F.lit("combined").alias("metric"), F.col("combined").alias("value")))).alias("m")).select("name", "m.metric", "m.value")]
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


#: For each metric the least weights of the graphs of spin glass, branching and Ising series, for the ring of cliques, the grid and the tree. Distances, knn: the
#: inverse of the least weight; cosine, pearson: the least weight; rbf: the least weight and gamma; enn: the radius.
THRESHOLDS = {
    "euclidean": ((62, 13.5, 31.5), (63, 13, 31.5), (62.5, 23.5, 31)),
    "mahalanobis_pair": ((2900, 130, 720), (2900, 130, 720), (2800, 300, 700)),
    "minkowski3": ((20, 5.6, 9.9), (19.65, 5.6, 9.95), (19.5, 7.5, 10)),
    "manhattan": ((2050, 185, 1025), (2050, 175, 1025), (2000, 450, 980)),
    "chebyshev": ((2, 11, 1), (2, 11.5, 1), (2, 11.5, 1)),
    "canberra": ((1000, 1450, 1025), (1025, 1450, 1025), (1000, 1450, 950)),
    "cosine": ((0.5, 0.5, 0.45), (0.75, 0.85, 0.475), (0.65, 0.65, 0.45)),
    "pearson": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5), (0.5, 0.15, 0.5)),
    "rbf": (((0.0125, 0.00125), (0.6, 0.0025), (0.1, 0.0025)), ((0.0125, 0.00125), (0.79, 0.00125), (0.1, 0.0025)), ((0.012, 0.0025), (0.45, 0.0025), (0.125, 0.0025))),
    "knn": ((60, 14, 31), (62, 13.5, 30), (62, 22.5, 32.5)),
    "enn": ((60, 14, 31), (62, 13.5, 30), (62, 22.5, 32.5)),
}
#: Neighbours of the knn graphs of series.
SERIES_NEIGHBORS = 15


def series_graph(ts: DataFrame, metric: str, at) -> DataFrame:
    """(u, v, w): the graph of series by one of THRESHOLDS' metrics and its threshold."""
    from orrery.operators.graphs import epsilon_graph, knn_distance_graph, metric_graph

    if metric == "knn":
        return knn_distance_graph(ts, SERIES_NEIGHBORS, 1 / at)
    if metric == "enn":
        return epsilon_graph(ts, at)
    if metric == "rbf":
        return metric_graph(ts, metric, *at)
    return metric_graph(ts, metric, at if metric in ("cosine", "pearson") else 1 / at)


def experiment(edges: DataFrame, nodes: int, metric: str, length: int = 2001, seed: int = 1, graph: str = "cliques") -> DataFrame:
    """(name, metric, value): graphs rebuilt from simulated series of three dynamics by one metric, compared with the graph itself. graph says whose thresholds are taken."""
    from orrery.operators.graphs import clean_points

    g = edges.withColumn("graph", F.lit(0).cast("bigint"))
    others = {}
    for model, at in zip(("spin_glass", "branching", "ising"), THRESHOLDS[metric][("cliques", "grid", "tree").index(graph)]):
        ts = materialize(clean_points(simulate(g, model, length, seed).select(F.col("node").alias("id"), "x")), "series")
        found = materialize(series_graph(ts, metric, at), "found")
        if not found.isEmpty():
            others[model] = found
    return compare_graphs(edges, others, nodes)


def graphical_lasso(points: DataFrame, penalty: float, rounds: int = 2_000, exact: float = 1e-9) -> DataFrame:
    """(u, v, w): partial correlations of each two series by the graphical lasso: the inverse covariance of the standardized series with an L1 penalty on its entries beside the
    diagonal. Pairs whose entry is 0 have no row.

    Series whose correlations are all within the penalty fall into groups that the solution keeps apart, exactly; so correlations are compared block by block, and each
    group of linked series is solved by itself by lasso.solve(). Equal series (to SURE_DIGITS, when standardized) have equal entries, so one of each is solved for and the
    others get theirs from it. Series without variation, and those of a group of one, have no links.
    """
    from orrery.operators import lasso
    from orrery.operators.components import connected_components
    from orrery.operators.graphs import SURE_DIGITS, _blocks, _matrix

    spark = points.sparkSession
    if penalty <= 0:
        raise ValueError("the penalty must be above 0")

    def standard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                x = np.stack(d["x"].to_numpy()).astype(float)
                least = 1e-14 * np.sqrt((x * x).sum(1))
                x = x - x.mean(1, keepdims=True)
                size = np.sqrt((x * x).sum(1))
                ok = np.isfinite(size) & (size > least)
                z = x[ok] / size[ok][:, None]
                yield pd.DataFrame({"id": d["id"][ok], "x": list(z), "same": list(np.round(z, SURE_DIGITS) + 0.0)})

    p = points.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x"))
    p = materialize(p.mapInPandas(standard, "id bigint, x array<double>, same array<double>"), "lasso-points")
    kinds = materialize(p.groupBy("same").agg(F.min("id").alias("id"), F.min_by("x", "id").alias("x"), F.count("*").alias("copies")).drop("same"), "lasso-kinds")
    copies = materialize(p.join(p.groupBy("same").agg(F.min("id").alias("kind")), "same").select("id", "kind"), "lasso-copies")

    def together(d: pd.DataFrame) -> pd.DataFrame:
        # Of the links of two blocks those of a spanning tree to the first series are enough.
        steps = list(_matrix(d, lambda a, b: np.abs(a @ b.T) > penalty))
        if not steps:
            return pd.DataFrame({"u": [], "v": []})
        li, ri, link = np.concatenate([s[0] for s in steps]), steps[0][1], np.concatenate([s[2] & s[3] for s in steps])
        u, v, left = [], [], np.ones(len(li), bool)
        for s in range(len(li)):
            if not left[s] or not link[s].any():
                continue
            rows, columns = np.zeros(len(li), bool), np.zeros(len(ri), bool)
            new = np.zeros(len(li), bool)
            new[s] = True
            while new.any():
                rows |= new
                columns |= link[new].any(0)
                new = link[:, columns].any(1) & ~rows
            left &= ~rows
            ends = np.concatenate([li[rows], ri[columns]])
            u.append(np.full(len(ends), li[s]))
            v.append(ends)
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}) if u else pd.DataFrame({"u": [], "v": []})

    links = _blocks(kinds.select("id", "x"))[0].groupBy("a", "b").applyInPandas(together, "u bigint, v bigint").where("u <> v")
    if penalty < 1:
        links = links.unionByName(kinds.where("copies > 1").select(F.col("id").alias("u"), F.col("id").alias("v")))
    groups = materialize(connected_components(links), "lasso-groups")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        m, ids = d["copies"].to_numpy().astype(float), d["id"].to_numpy()
        i, j, v, k = lasso.solve(np.stack(d["x"].to_numpy()), m, penalty, exact, rounds)
        # One copy's own entry, and that between two copies.
        apart = np.maximum(1 / penalty, k / m)
        between = (k / m - apart) / m
        own = apart + between
        more = np.nonzero((m > 1) & (between < 0))[0]
        w = np.concatenate([-v / (m[i] * m[j]) / np.sqrt(own[i] * own[j]), -between[more] / own[more]])
        return pd.DataFrame({"i": np.concatenate([ids[i], ids[more]]), "j": np.concatenate([ids[j], ids[more]]), "w": w})

    g = groups.join(kinds, groups["node"] == kinds["id"]).select("component", "id", "x", "copies")
    solved = materialize(g.groupBy("component").applyInPandas(run, "i bigint, j bigint, w double"), "lasso-pairs")
    ends = lambda end, name: copies.select(F.col("kind").alias(end), F.col("id").alias(name))
    both = solved.join(ends("i", "a"), "i").join(ends("j", "b"), "j").where("i <> j OR a < b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")
