"""Graphs from points: pairwise metrics, nearest neighbours, radius and kernel graphs, repair and bridging.

Points are (id BIGINT, x ARRAY<DOUBLE>), edges (u, v, w) with u < v, once each. Rows with a null id, a null or empty vector, or a null or NaN
entry are no points. Pairs are compared in blocks: points fall into blocks by a hash of their id, each pair of blocks is one group of bounded
size, and only what is asked for leaves it. Points of at most three dimensions are looked up in cells instead, in all but the metric graphs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions.metrics import METRICS, OWN_WEIGHT
from orrery.operators.components import connected_components
from orrery.plans.scratch import materialize

#: Points of a block; pairs that a step holds in memory.
BLOCK, STEP = 2_000, 1_000_000
EPS = 1e-5


def clean_points(points: DataFrame, x: str = "x") -> DataFrame:
    """(id, x): usable points, one per id."""
    v = F.col(x).cast("array<double>")
    ok = F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e))
    return points.where(F.coalesce(ok, F.lit(False))).select(F.col("id").cast("bigint").alias("id"), v.alias("x")).dropDuplicates(["id"])


def _blocks(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Every point in each pair of blocks that it belongs to: (a, b, left, id, x). Blocks have so many points; each point is sent once for every block."""
    n = max(1, math.ceil(points.count() / block))
    p = points.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    pairs = p.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), (F.col("k") <= F.col("o")).alias("left"), "id", "x", "k"), n


def _sides(d: pd.DataFrame) -> tuple:
    same = d["a"].iloc[0] == d["b"].iloc[0]
    d = d.sort_values("id")
    left = d if same else d[d["k"] == d["a"]]
    right = d if same else d[d["k"] == d["b"]]
    mat = lambda s: np.stack(s["x"].to_numpy()).astype(float) if len(s) else np.zeros((0, 1))
    return left["id"].to_numpy(), mat(left), right["id"].to_numpy(), mat(right), same


def _matrix(d: pd.DataFrame, metric: Callable) -> Iterator[tuple]:
    """(ids of rows, ids of columns, values, mask of the pairs that count) step by step."""
    li, lx, ri, rx, same = _sides(d)
    if not len(li) or not len(ri):
        return
    rows = max(1, STEP // len(ri))
    for s in range(0, len(li), rows):
        m = metric(lx[s : s + rows], rx)
        ids = li[s : s + rows]
        yield ids, ri, m, (ids[:, None] < ri[None]) if same else np.ones(m.shape, bool)


def pairs(points: DataFrame, metric: str | Callable, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(u, v, d), u < v: the pairs whose value of the metric is within low and high, both included. NaN is outside."""
    f = METRICS[metric] if isinstance(metric, str) else metric

    def run(d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for li, ri, m, count in _matrix(d, f):
            i, j = np.nonzero(count & (m >= low) & (m <= high))
            out.append(pd.DataFrame({"u": np.minimum(li[i], ri[j]), "v": np.maximum(li[i], ri[j]), "d": m[i, j]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"u": [], "v": [], "d": []})

    return _blocks(points)[0].groupBy("a", "b").applyInPandas(run, "u bigint, v bigint, d double")


#: Digits of absolute values that tell pairs apart: what lies behind is noise of the order in which products are added.
SURE_DIGITS = 12


def strongest_pairs(points: DataFrame, metric: str | Callable, n: int) -> DataFrame:
    """(u, v, d): all pairs among the n of largest absolute value of the metric (equal ones, to SURE_DIGITS: smaller ends first), and few others. NaN ones don't count.

    The n-th largest value of the pairs within single blocks is no larger than that of all pairs, so pairs below it are left where they are found, and no block gives
    more than n. So all pairs are compared and few are written.
    """
    f = METRICS[metric] if isinstance(metric, str) else metric
    width = points.select(F.max(F.size("x"))).first()[0] or 1
    blocks = _blocks(points, max(BLOCK // 4, min(4 * BLOCK, 4_000_000 // width)))[0]

    def largest(d: pd.DataFrame) -> pd.DataFrame:
        got, low = np.zeros(0), -1.0
        for _, _, m, count in _matrix(d, f):
            m = np.abs(m)
            got = np.concatenate([got, m[count & (m > low)]])
            if len(got) > 2 * n:
                got = np.partition(got, len(got) - n)[-n:]
                low = got.min()
        return pd.DataFrame({"d": np.sort(got)[-n:]})

    def run(d: pd.DataFrame) -> pd.DataFrame:
        out, held = [], 0

        def best() -> list[np.ndarray]:
            u, v, w = (np.concatenate(c) for c in zip(*out))
            o = np.lexsort((v, u, -np.round(np.abs(w), SURE_DIGITS)))[:n]
            return [u[o], v[o], w[o]]

        same = d["a"].iloc[0] == d["b"].iloc[0]
        for li, ri, m, count in _matrix(d, f):
            ok = np.abs(m) >= low
            i, j = np.nonzero(ok & count if same else ok)
            out.append([np.minimum(li[i], ri[j]), np.maximum(li[i], ri[j]), m[i, j]])
            held += len(i)
            if held > 2 * n + STEP:
                out, held = [best()], n
        return pd.DataFrame(dict(zip("uvd", best()))) if out else pd.DataFrame({"u": [], "v": [], "d": []})

    if n < 1:
        return points.sparkSession.createDataFrame([], "u bigint, v bigint, d double")
    own = blocks.where("a = b").groupBy("a", "b").applyInPandas(largest, "d double").orderBy(F.desc("d")).limit(n).agg(F.count("*"), F.min("d")).first()
    low = own[1] - 2 * 10.0**-SURE_DIGITS if own[0] == n else -math.inf
    return blocks.groupBy("a", "b").applyInPandas(run, "u bigint, v bigint, d double")


def pair_range(points: DataFrame, metric: str | Callable) -> DataFrame:
    """(n, low, high, total), one row: number, least, greatest and sum of the values of all pairs. NaN ones don't count."""
    f = METRICS[metric] if isinstance(metric, str) else metric

    def run(d: pd.DataFrame) -> pd.DataFrame:
        got = [m[count & ~np.isnan(m)] for _, _, m, count in _matrix(d, f)]
        got = [g for g in got if len(g)]
        return pd.DataFrame({"n": [sum(map(len, got))], "low": [min(g.min() for g in got)], "high": [max(g.max() for g in got)], "total": [sum(g.sum() for g in got)]}) if got else pd.DataFrame({"n": [], "low": [], "high": [], "total": []})

    part = _blocks(points)[0].groupBy("a", "b").applyInPandas(run, "n bigint, low double, high double, total double")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


def histogram(points: DataFrame, metric: str, bins: int = 100) -> DataFrame:
    """(bin, low, n, density): equal bins of all pairs' values, the last closed; bins without pairs have no row. Counts are of unordered pairs."""
    f = METRICS[metric]
    r = pair_range(points, metric).first()
    if not r["n"]:
        return points.sparkSession.createDataFrame([], "bin int, low double, n bigint, density double")
    lo, hi, total = r["low"], r["high"], r["n"]
    width = (hi - lo) / bins

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins, np.int64)
        for _, _, m, count in _matrix(d, f):
            v = m[count & ~np.isnan(m)]
            k = np.floor((v - lo) / width).astype(int) if width > 0 else np.zeros(len(v), int)
            n += np.bincount(np.clip(k, 0, bins - 1), minlength=bins)
        return pd.DataFrame({"bin": np.nonzero(n)[0], "n": n[n > 0]})

    h = _blocks(points)[0].groupBy("a", "b").applyInPandas(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    return h.select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), "n", F.try_divide(F.col("n"), F.lit(total * width)).alias("density"))


def fitted(points: DataFrame, metric: str, bins: int = 1000) -> DataFrame:
    """(family, location, scale): normal (mean, deviation) and Laplace (median, mean absolute deviation from it) fitted to the histogram of all pairs' values."""
    h = histogram(points, metric, bins).withColumn("mid", F.col("low") + F.try_divide(F.col("n"), F.col("density") * F.sum("n").over(W.partitionBy())) / 2)
    h = h.withColumn("upto", F.sum("n").over(W.orderBy("bin"))).withColumn("all", F.sum("n").over(W.partitionBy()))
    m = h.agg((F.sum(F.col("n") * F.col("mid")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("mid"))).alias("median"))
    s = h.crossJoin(F.broadcast(m)).groupBy("mean", "median").agg(F.sqrt(F.sum(F.col("n") * (F.col("mid") - F.col("mean")) ** 2) / F.sum("n")).alias("sd"), (F.sum(F.col("n") * F.abs(F.col("mid") - F.col("median"))) / F.sum("n")).alias("mad"))
    return s.select(F.explode(F.array(F.struct(F.lit("norm").alias("family"), F.col("mean").alias("location"), F.col("sd").alias("scale")), F.struct(F.lit("laplace").alias("family"), F.col("median").alias("location"), F.col("mad").alias("scale")))).alias("f")).select("f.*")


def metric_graph(points: DataFrame, metric: str | Callable, least: float, gamma: float | None = None) -> DataFrame:
    """(u, v, w): the pairs whose weight is at least `least`.

    The weight of a distance d is 1/d, or the greatest distance of all pairs where d <= 1e-5; of similarity measures in OWN_WEIGHT it is the value
    itself; of rbf the inverse of the similarity.
    """
    from orrery.functions.metrics import rbf

    f = metric if callable(metric) else rbf(gamma) if metric == "rbf" and gamma is not None else METRICS[metric]
    if metric in OWN_WEIGHT:
        return pairs(points, f, low=least).select("u", "v", F.col("d").alias("w"))
    near = pairs(points, f, high=max(1 / least if least > 0 else math.inf, EPS))
    if metric == "rbf":
        return near.select("u", "v", (1 / F.col("d")).alias("w")).where(F.col("w") >= least)
    near = materialize(near, "metric-pairs")
    if near.where(F.col("d") <= EPS).isEmpty():
        return near.select("u", "v", (1 / F.col("d")).alias("w")).where(F.col("w") >= least)
    # Only pairs at no distance need the greatest one, which takes a second pass over all pairs.
    top = pair_range(points, f).select(F.col("high").alias("top"))
    w = F.when(F.col("d") <= EPS, F.col("top")).otherwise(1 / F.col("d"))
    return near.join(F.broadcast(top)).select("u", "v", w.alias("w")).where(F.col("w") >= least)


#: Dimensions up to which points are looked up in cells.
CELL_DIMS = 3


def _dims(points: DataFrame) -> int:
    return points.select(F.max(F.size("x"))).first()[0] or 1


def _cells(p: DataFrame, r: float, dims: int, around: bool) -> DataFrame:
    """p with the columns c0, c1, ... of the cell of width r of each point, or of all cells around it."""
    at = [F.floor(F.get("x", F.lit(k)) / r) for k in range(dims)]
    if not around:
        return p.select("*", *[c.alias(f"c{k}") for k, c in enumerate(at)])
    every = F.explode(F.array(*[F.struct(*[(c + o).alias(f"c{k}") for k, (c, o) in enumerate(zip(at, off))]) for off in itertools.product((-1, 0, 1), repeat=dims)]))
    return p.select("*", every.alias("_c")).select("*", "_c.*").drop("_c")


def _spread(points: DataFrame, k: int, dims: int) -> tuple[float, float]:
    """A first width of cells, well below the mean distance of k-th neighbours, and the diagonal of all points."""
    got = points.agg(F.count("*").alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{a}{i}") for i in range(dims) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    sides = [(got[f"hi{i}"] or 0.0) - (got[f"lo{i}"] or 0.0) for i in range(dims)]
    diagonal = math.sqrt(sum(x * x for x in sides))
    return (max(sides) / max(1.0, (got["n"] / k) ** (1 / dims)) / 8 or 1.0), diagonal


def _nearest_in_cells(queries: DataFrame, points: DataFrame, k: int, dims: int, condition: Column | None = None) -> DataFrame:
    """(id, other, d, rank): of each query (id, x, ...) its k nearest points (other, x, ...) that meet a condition on the columns of both, in which those of a query begin with q_.

    Rings of cells: cells begin narrow; a query that has k points within their width is done, the others go on with cells twice as wide. So crowded places are done
    before cells get wide, and every round joins fewer queries; each round keeps k rows a query.
    """
    from orrery.functions.metrics import euclidean

    r, diagonal = _spread(points.select("x").unionByName(queries.select("x")), k, dims)
    todo = queries.select(*[F.col(c).alias("q_" + c) for c in queries.columns])
    done: list[DataFrame] = []
    while True:
        q = _cells(todo.withColumn("x", F.col("q_x")), r, dims, True).drop("x")
        j = q.join(_cells(points, r, dims, False), [f"c{i}" for i in range(dims)])
        if condition is not None:
            j = j.where(condition)
        j = j.select("q_id", "other", euclidean(F.col("q_x"), F.col("x")).alias("d"))
        top = j.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("d", "other"))).where(F.col("rank") <= k)
        top = materialize(top, "nearest-cells")
        if r > diagonal:
            done.append(top)
            break
        sure = top.where((F.col("rank") == k) & (F.col("d") <= r)).select("q_id")
        done.append(top.join(sure, "q_id", "left_semi"))
        todo = materialize(todo.join(sure, "q_id", "left_anti"), "nearest-open")
        if todo.isEmpty():
            break
        r *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("q_id").alias("id"), "other", "d", "rank")


def _nearest_places(points: DataFrame, k: int, dims: int) -> DataFrame:
    """nearest() in cells. Of points at one place only the k + 1 with the smallest ids can be anyone's neighbours; the others have those of the last of these."""
    c = materialize(points.select("id", "x", F.row_number().over(W.partitionBy("x").orderBy("id")).alias("copy")), "nearest-copies")
    few = c.where(F.col("copy") <= k + 1).select("id", "x")
    got = _nearest_in_cells(few, few.withColumnRenamed("id", "other"), k, dims, F.col("q_id") != F.col("other"))
    last = c.where(F.col("copy") == k + 1).select("x", F.col("id").alias("rep"))
    more = c.where(F.col("copy") > k + 1).select("id", "x").join(last, "x").select("id", "rep")
    return got.unionByName(more.join(got.withColumnRenamed("id", "rep"), "rep").select("id", "other", "d", "rank"))


def nearest(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, other, d, rank): the k nearest others of each point; equal distances: smaller id first. Euclidean ones of up to three dimensions are looked up in rings of
    cells; else all pairs are compared, and each block gives its best k first."""
    if metric == "euclidean" and (dims := _dims(points)) <= CELL_DIMS:
        return _nearest_places(points, k, dims)
    f = METRICS[metric]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        li, lx, ri, rx, same = _sides(d)
        out = []
        for ai, ax, bi, bx in [(li, lx, ri, rx)] if same else [(li, lx, ri, rx), (ri, rx, li, lx)]:
            if not len(ai) or not len(bi):
                continue
            rows = max(1, STEP // len(bi))
            for s in range(0, len(ai), rows):
                m = f(ax[s : s + rows], bx)
                ids = ai[s : s + rows]
                m[ids[:, None] == bi[None]] = np.inf
                m[np.isnan(m)] = np.inf
                c = min(k, len(bi) - 1)
                cut = np.partition(m, c, axis=1)[:, c : c + 1]
                i, j = np.nonzero((m <= cut) & np.isfinite(m))
                o = np.lexsort((bi[j], m[i, j], i))
                i, j = i[o], j[o]
                first = np.searchsorted(i, i)
                ok = np.arange(len(i)) - first < k
                out.append(pd.DataFrame({"id": ids[i[ok]], "other": bi[j[ok]], "d": m[i[ok], j[ok]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "other": [], "d": []})

    best = _blocks(points)[0].groupBy("a", "b").applyInPandas(run, "id bigint, other bigint, d double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("d", "other"))).where(F.col("rank") <= k)


def nearest_of(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(id, other, d): for each query point the nearest of the others (equal distances: smaller id). Up to three dimensions by rings of cells, else queries meet the
    points block by block."""
    if (dims := _dims(points)) <= CELL_DIMS:
        few = points.groupBy("x").agg(F.min("id").alias("other"))
        return _nearest_in_cells(queries.select("id", "x"), few, 1, dims).select("id", "other", "d")
    tagged = queries.select((-F.col("id") - 1).alias("id"), "x").unionByName(points.select("id", "x"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        li, lx, ri, rx, same = _sides(d)
        out = []
        for ai, ax, bi, bx in [(li, lx, ri, rx)] if same else [(li, lx, ri, rx), (ri, rx, li, lx)]:
            ax, ai, bx, bi = ax[ai < 0], ai[ai < 0], bx[bi >= 0], bi[bi >= 0]
            if not len(ai) or not len(bi):
                continue
            rows = max(1, STEP // len(bi))
            for s in range(0, len(ai), rows):
                m = METRICS["euclidean"](ax[s : s + rows], bx)
                j = m.argmin(1)
                out.append(pd.DataFrame({"id": -ai[s : s + rows] - 1, "other": bi[j], "d": m[np.arange(len(j)), j]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "other": [], "d": []})

    best = _blocks(tagged)[0].groupBy("a", "b").applyInPandas(run, "id bigint, other bigint, d double")
    return best.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.d").alias("d"))


def radius_pairs(points: DataFrame, r: float) -> DataFrame:
    """(u, v, d): pairs at most r apart, which counts. Up to three dimensions by an equi-join on cells of width r; else block by block."""
    dims = _dims(points)
    if dims > CELL_DIMS or r <= 0:
        return pairs(points, "euclidean", high=r)
    left = _cells(points.select("id", "x"), r, dims, True).withColumnsRenamed({"id": "u", "x": "xu"})
    right = _cells(points.select("id", "x"), r, dims, False).withColumnsRenamed({"id": "v", "x": "xv"})
    from orrery.functions.metrics import euclidean

    j = left.join(right, [f"c{k}" for k in range(dims)]).where("u < v").withColumn("d", euclidean(F.col("xu"), F.col("xv")))
    return j.where(F.col("d") <= r).select("u", "v", "d")


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """(u, v, w, d): half the sum of the two directed distances of a pair, so a one-way pair counts half; w = 1/(value + 1e-5). Pairs at distance 0 have no edge."""
    n = nearest(points, k).groupBy(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).agg(F.sum("d").alias("s"), F.max("d").alias("d"))
    return n.where(F.col("s") > 0).select("u", "v", (1 / (F.col("s") / 2 + EPS)).alias("w"), "d")


def radius_graph(points: DataFrame, r: float) -> DataFrame:
    """(u, v, w, d): pairs at most r apart, w = 1/(d + 1e-5). Pairs at distance 0 have no edge."""
    return radius_pairs(points, r).where(F.col("d") > 0).select("u", "v", (1 / (F.col("d") + EPS)).alias("w"), "d")


#: Parts of the radius by which radius_links() thins out the points of a cell.
THIN = 16
#: Points up to which comparing all is quicker than looking for few links.
FEW = 5_000


def radius_links(points: DataFrame, r: float) -> DataFrame:
    """(u, v): some of the edges of radius_graph(), which join the same points as all of them: as many as points, and some for each two cells close by.

    All places of a cell as wide as the radius in its diagonal are joined, by a star. Two cells are joined by the closest of a few of their places, if it is close enough;
    where these are too far apart but others may not be, all are compared, unless the cells hang together anyway. Copies at one place hang on its neighbour.
    """
    dims = _dims(points)
    if dims > CELL_DIMS or r <= 0 or points.count() <= FEW:
        return radius_graph(points, r).select("u", "v")
    width = r / math.sqrt(dims) * (1 - 1e-9)
    keys = [f"c{k}" for k in range(dims)]
    few = points.groupBy("x").agg(F.min("id").alias("id"))
    few = _cells(few, width, dims, False).withColumn("cell", F.array(*keys)).withColumn("thin", F.array(*[F.floor(F.get("x", F.lit(k)) / (width / THIN)) for k in range(dims)]))
    few = materialize(few.withColumn("head", F.min("id").over(W.partitionBy("cell"))).select("id", "x", "cell", "thin", "head"), "links-places")
    star = few.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    thin = materialize(few.groupBy("cell", "head", "thin").agg(F.min(F.struct("id", "x")).alias("m")).select("cell", "head", "m.id", "m.x"), "links-thin")
    cells = thin.select("cell", "head").distinct()
    reach = math.ceil(math.sqrt(dims)) + 1
    offsets = [o for o in itertools.product(range(-reach, reach + 1), repeat=dims) if o > (0,) * dims and math.sqrt(sum(max(abs(x) - 1, 0) ** 2 for x in o)) * width <= r * (1 + 1e-9)]
    other = F.explode(F.array(*[F.array(*[F.get("cell", F.lit(k)) + x for k, x in enumerate(o)]) for o in offsets]))
    near = cells.select(F.col("head").alias("a"), other.alias("cell")).join(cells.withColumnRenamed("head", "b"), "cell").select("a", "b")

    def closest(pairs: DataFrame, places: DataFrame) -> DataFrame:
        """(a, b, u, v, d): of each two cells the closest two places."""
        x = places.select("head", "id", "x")
        sides = pairs.join(x, pairs["a"] == x["head"]).select("a", "b", F.lit(True).alias("left"), "id", "x").unionByName(pairs.join(x, pairs["b"] == x["head"]).select("a", "b", F.lit(False).alias("left"), "id", "x"))

        def run(d: pd.DataFrame) -> pd.DataFrame:
            side = d["left"].to_numpy()
            ids, x = d["id"].to_numpy(), np.stack(d["x"].to_numpy()).astype(float)
            (li, lx), (ri, rx) = (ids[side], x[side]), (ids[~side], x[~side])
            best = None
            rows = max(1, STEP // len(ri))
            for s in range(0, len(li), rows):
                m = METRICS["euclidean"](lx[s : s + rows], rx)
                i, j = divmod(int(m.argmin()), len(ri))
                if best is None or m[i, j] < best[2]:
                    best = li[s + i], ri[j], m[i, j]
            return pd.DataFrame({"a": d["a"].iloc[:1], "b": d["b"].iloc[:1], "u": [best[0]], "v": [best[1]], "d": [best[2]]})

        return materialize(sides.groupBy("a", "b").applyInPandas(run, "a bigint, b bigint, u bigint, v bigint, d double"), "links-cells")

    first = closest(near, thin)
    across = first.where(F.col("d") <= r)
    # A place lies within the diagonal of a small cell from the one taken for it.
    maybe = first.where((F.col("d") > r) & (F.col("d") <= r + 2 * r / THIN * (1 + 1e-6))).select("a", "b")
    comp = materialize(connected_components(across.select("a", "b").unionByName(cells.select(F.col("head").alias("a"), F.col("head").alias("b"))), "a", "b"), "links-components")
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias("c_" + c))
    open_ = materialize(maybe.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").select("a", "b"), "links-open")
    links = star.unionByName(across.select("u", "v"))
    if not open_.isEmpty():
        links = links.unionByName(closest(open_, few).where(F.col("d") <= r).select("u", "v"))
    links = materialize(links, "links")
    # Copies have an edge to a neighbour of their place, if it has one.
    by = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
    place = few.select("x", F.col("id").alias("place"))
    copies = points.join(place, "x").where("id <> place").join(by, F.col("place") == F.col("u")).select(F.col("id").alias("u"), "v")
    out = links.unionByName(copies)
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def rbf_graph(points: DataFrame, least: float, gamma: float | None = None, gamma_mode: str = "compat") -> DataFrame:
    """(u, v, w, d): pairs with a kernel of at least `least`, w = the kernel. gamma_mode 'compat' takes 1/dimensions for gamma, 'as_given' the given one."""
    dims = points.select(F.max(F.size("x"))).first()[0] or 1
    g = 1 / dims if gamma_mode == "compat" or gamma is None else gamma
    r = math.sqrt(-math.log(least) / g) if least < 1 else 0.0
    return radius_pairs(points, max(r, 1e-12) * (1 + 1e-12)).select("u", "v", F.exp(-g * F.col("d") * F.col("d")).alias("w"), "d").where(F.col("w") >= least)


#: Most long edges that prune(mode="exact") plays through on the driver.
MOST_LONG = 2_000_000


def prune(edges: DataFrame, longest: float, mode: str = "declarative") -> DataFrame:
    """Edges (u, v, w, d) without the long ones, but for the nearest long edge of a node that has no short one, whose weight is 1/(d + 1e-5).

    mode='exact' takes the nodes one after another by number, each by what the ones before have left: a node of several edges drops its long ones, and if it had no
    other it keeps one, the nearest. A node with a single edge keeps it. Short edges never go, so only the long ones are played through, in one place; more than MOST_LONG raise.
    """
    if mode == "exact":
        return _prune_in_order(edges, longest)
    short = edges.where(F.col("d") <= longest)
    ends = edges.select("u", "v", "d", F.explode(F.array("u", "v")).alias("node"))
    alone = ends.groupBy("node").agg(F.min(F.struct("d", "u", "v")).alias("m")).where(F.col("m.d") > longest).select("m.u", "m.v", "m.d").distinct()
    return short.unionByName(alone.select("u", "v", (1 / (F.col("d") + EPS)).alias("w"), "d"))


def _prune_in_order(edges: DataFrame, longest: float) -> DataFrame:
    short = edges.where(F.col("d") <= longest)
    rows = edges.where(F.col("d") > longest).select("u", "v", "d").limit(MOST_LONG + 1).collect()
    if len(rows) > MOST_LONG:
        raise ValueError(f"more than {MOST_LONG} long edges: use the declarative mode")
    near: dict[int, dict[int, float]] = {}
    for r in rows:
        near.setdefault(r["u"], {})[r["v"]] = near.setdefault(r["v"], {})[r["u"]] = r["d"]
    nodes = edges.sparkSession.createDataFrame([(n,) for n in near], "node bigint")
    of = short.select(F.explode(F.array("u", "v")).alias("node")).join(F.broadcast(nodes), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    shorts = {r["node"]: r["n"] for r in of.collect()}
    again = set()
    for n in sorted(near):
        if len(near[n]) + shorts.get(n, 0) < 2 or not near[n]:
            continue
        keep = None if shorts.get(n) else min(near[n], key=lambda o: (near[n][o], o))
        for o in [o for o in near[n] if o != keep]:
            del near[n][o], near[o][n]
            again.discard((min(n, o), max(n, o)))
        if keep is not None:
            again.add((min(n, keep), max(n, keep)))
    left = [(n, o, d, (n, o) in again) for n in near for o, d in near[n].items() if n < o]
    kept = edges.sparkSession.createDataFrame(left, "u bigint, v bigint, d double, again boolean").join(edges.select("u", "v", "w"), ["u", "v"])
    return short.unionByName(kept.select("u", "v", F.when(F.col("again"), 1 / (F.col("d") + EPS)).otherwise(F.col("w")).alias("w"), "d"))


def isolated(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x): points without an edge."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return points.join(ends, "id", "left_anti")


def rbf_weight(d: Column, gamma: float) -> Column:
    """The weight of an edge that repairs or joins a kernel graph: sqrt(ln(exp(-gamma d^2) + 1e-5) / -gamma) / (d + 1e-5); 0 where the root would be of a negative number."""
    inner = F.log(F.exp(-gamma * d * d) + EPS) / -gamma
    return F.sqrt(F.greatest(inner, F.lit(0.0))) / (d + EPS)


def _weight(d: Column, gamma: float | None) -> Column:
    return 1 / (d + EPS) if gamma is None else rbf_weight(d, gamma)


def repair(points: DataFrame, edges: DataFrame, gamma: float | None = None) -> DataFrame:
    """(u, v, w): one edge for each isolated point: to the nearest point that has edges or is isolated itself with a smaller id; w = 1/(d + 1e-5), for a kernel graph with its
    gamma rbf_weight()."""
    alone = materialize(isolated(points, edges), "repair")
    if (dims := _dims(points)) <= CELL_DIMS:
        tagged = points.select(F.col("id").alias("other"), "x").join(alone.select(F.col("id").alias("other"), F.lit(True).alias("alone")), "other", "left")
        # The first isolated point finds nobody if no point has edges.
        best = _nearest_in_cells(alone, tagged, 1, dims, (F.col("q_id") != F.col("other")) & (F.col("alone").isNull() | (F.col("other") < F.col("q_id"))))
        return best.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), _weight(F.col("d"), gamma).alias("w"))
    linked = points.join(alone.select("id"), "id", "left_anti")
    to_linked = nearest_of(alone, linked)
    first = pairs(alone, "euclidean").select(F.col("v").alias("id"), F.col("u").alias("other"), "d")
    best = to_linked.unionByName(first).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m"))
    return best.select(F.least("id", "m.other").alias("u"), F.greatest("id", "m.other").alias("v"), _weight(F.col("m.d"), gamma).alias("w"))


def _bridges_in_cells(tagged: DataFrame, dims: int) -> DataFrame:
    """(u, v, d): the shortest edge that leaves each component but the largest, by rings of cells: a component is done when its edge is no longer than the cells are wide."""
    from orrery.functions.metrics import euclidean

    size = materialize(tagged.groupBy("component").agg(F.count("*").alias("n")), "bridge-sizes")
    top = size.orderBy(F.desc("n"), "component").limit(1).select("component")
    r, diagonal = _spread(tagged, 1, dims)
    todo, found = materialize(size.join(top, "component", "left_anti").select("component"), "bridge-open"), []
    right = tagged.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("component").alias("oc"))
    while not todo.isEmpty():
        q = _cells(tagged.join(todo, "component", "left_semi"), r, dims, True)
        j = q.join(_cells(right.withColumn("x", F.col("ox")), r, dims, False).drop("x"), [f"c{i}" for i in range(dims)]).where("component <> oc")
        best = j.groupBy("component").agg(F.min(F.struct(euclidean(F.col("x"), F.col("ox")).alias("d"), F.least("id", "o").alias("u"), F.greatest("id", "o").alias("v"))).alias("m"))
        best = materialize(best.where((F.col("m.d") <= r) | F.lit(r > diagonal)), "bridge-best")
        found.append(best.select("m.u", "m.v", "m.d"))
        if r > diagonal:
            break
        todo = materialize(todo.join(best, "component", "left_anti"), "bridge-open")
        r *= 2
    if not found:
        return tagged.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("d")).where(F.lit(False))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def bridge_round(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, d): the shortest edge that leaves each component, each once. None with a single component."""
    comp = connected_components(edges.select("u", "v").unionByName(points.select(F.col("id").alias("u"), F.col("id").alias("v"))))
    comp = materialize(comp, "bridge")
    tagged = points.join(comp, points["id"] == comp["node"]).select("id", "x", "component")
    n = max(1, math.ceil(tagged.count() / BLOCK))
    p = tagged.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = p.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), "id", "x", "k", "component")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(d["id"], d["component"]))
        best: dict = {}
        for li, ri, m, count in _matrix(d, METRICS["euclidean"]):
            lc, rc = np.array([of[i] for i in li]), np.array([of[i] for i in ri])
            m = np.where(count & (lc[:, None] != rc[None]), m, np.inf)
            for mine, ids, own, others in ((m, li, lc, ri), (m.T, ri, rc, li)):
                low = mine.min(1)
                for c in np.unique(own[np.isfinite(low)]):
                    for i in np.nonzero((own == c) & (low == low[own == c].min()))[0]:
                        for j in np.nonzero(mine[i] == low[i])[0]:
                            e = (low[i], min(ids[i], others[j]), max(ids[i], others[j]))
                            if c not in best or e < best[c]:
                                best[c] = e
        return pd.DataFrame([(c, *e) for c, e in best.items()], columns=["component", "d", "u", "v"])

    best = p.groupBy("a", "b").applyInPandas(run, "component bigint, d double, u bigint, v bigint")
    return best.groupBy("component").agg(F.min(F.struct("d", "u", "v")).alias("m")).select("m.u", "m.v", "m.d").distinct()


def bridge(points: DataFrame, edges: DataFrame, gamma: float | None = None) -> DataFrame:
    """(u, v, w): the edges that join all components at least length, one fewer than there are components; w = 1/(d + 1e-5), for a kernel graph with its gamma rbf_weight().

    Each round takes the shortest edge of every component, so rounds grow with the logarithm of their number; it ends when one is left. Up to three dimensions edges are
    found by rings of cells, and the largest component waits for the others' edges.
    """
    all_, added, dims = edges.select("u", "v"), None, _dims(points)
    tagged = None
    if dims <= CELL_DIMS:
        comp = connected_components(all_.unionByName(points.select(F.col("id").alias("u"), F.col("id").alias("v"))))
        tagged = materialize(points.join(comp, points["id"] == comp["node"]).select("id", "x", "component"), "bridge-points")
    while True:
        new = materialize(bridge_round(points, all_) if tagged is None else _bridges_in_cells(tagged, dims), "bridge-round")
        if new.isEmpty():
            break
        added = new if added is None else added.unionByName(new)
        all_ = all_.unionByName(new.select("u", "v"))
        if tagged is not None:
            # The components of components: only those are joined anew.
            of = tagged.select("id", "component")
            links = new.join(of.withColumnsRenamed({"id": "u", "component": "a"}), "u").join(of.withColumnsRenamed({"id": "v", "component": "b"}), "v")
            up = connected_components(links.select("a", "b"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("up"))
            tagged = materialize(tagged.join(up, "component", "left").select("id", "x", F.coalesce("up", "component").alias("component")), "bridge-points")
    if added is None:
        return edges.select("u", "v", F.lit(0.0).alias("w")).where(F.lit(False))
    return added.select("u", "v", _weight(F.col("d"), gamma).alias("w"))


def epsilon_graph(points: DataFrame, r: float) -> DataFrame:
    """(u, v, w): pairs at most r apart, w = 1."""
    return radius_pairs(points, r).select("u", "v", F.lit(1.0).alias("w"))


def knn_distance_graph(points: DataFrame, k: int, least: float) -> DataFrame:
    """(u, v, w): each point with its k - 1 nearest others, as the point itself is the first of the k; w = 1/d, or the greatest of the distances where d < 1e-5; at least `least`."""
    n = nearest(points, k - 1)
    top = n.agg(F.max("d").alias("top"))
    w = F.when(F.col("d") < EPS, F.col("top")).otherwise(1 / F.col("d"))
    e = n.join(F.broadcast(top)).select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), w.alias("w")).where(F.col("w") >= least)
    return e.groupBy("u", "v").agg(F.max("w").alias("w"))


def with_attributes(nodes: DataFrame, points: DataFrame, prefix: str = "x_") -> DataFrame:
    """nodes (id, ...) with a column for each dimension of their points: x_0, x_1 and so on; null for nodes without a point, which stay. A subset of nodes, or a
    single one, is just fewer rows. A column of the same name is replaced."""
    dims = _dims(points)
    p = points.select("id", *[F.get("x", F.lit(k)).alias(f"{prefix}{k}") for k in range(dims)])
    return nodes.drop(*[c for c in p.columns if c != "id"]).join(p, "id", "left")


def fitted_t(points: DataFrame, metric: str, bins: int = 1000, rounds: int = 200) -> DataFrame:
    """(family, location, scale, df), one row: Student's t of most likelihood for the histogram of all pairs' values, by expectation maximization over degrees of freedom from
    1 to 200. The histogram has at most `bins` rows, which one task takes. No pairs give no rows."""
    h = histogram(points, metric, bins)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bin")
        step = 1 / (d["density"] * d["n"].sum() / d["n"]).median() if len(d) > 1 else 0.0
        x, n = d["low"].to_numpy() + step / 2, d["n"].to_numpy().astype(float)
        best = None
        for df in (1, 1.5, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50, 100, 200):
            m, s = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-12)
            for _ in range(rounds):
                w = (df + 1) / (df + ((x - m) / s) ** 2) * n
                m2 = (w * x).sum() / w.sum()
                s2 = max(math.sqrt((w * (x - m2) ** 2).sum() / n.sum()), 1e-12)
                if abs(m2 - m) + abs(s2 - s) < 1e-12:
                    break
                m, s = m2, s2
            like = (n * (math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(s) - (df + 1) / 2 * np.log1p(((x - m) / s) ** 2 / df))).sum()
            if best is None or like > best[0]:
                best = (like, m, s, float(df))
        return pd.DataFrame({"family": ["t"], "location": [best[1]], "scale": [best[2]], "df": [best[3]]})

    return h.groupBy(F.lit(0).alias("all")).applyInPandas(lambda d: run(d), "family string, location double, scale double, df double")
