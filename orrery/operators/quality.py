"""How good a clustering of points is."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.metrics import METRICS
from orrery.operators.graphs import _blocks, _sides
from orrery.plans.scratch import materialize


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(silhouette, n), one row: mean silhouette by exact euclidean distances; points alone in their cluster count 0. Null with fewer than two clusters.

    Each pair of blocks gives, for every point, the sum of distances to each cluster: pairs never leave their block.
    """
    lab = labels.select("id", "label")
    p = points.join(lab, "id").select("id", F.concat("x", F.array(F.col("label").cast("double"))).alias("x"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        li, lx, ri, rx, same = _sides(d)
        out = []
        for ai, ax, bi, bx in [(li, lx, ri, rx)] if same else [(li, lx, ri, rx), (ri, rx, li, lx)]:
            if not len(ai) or not len(bi):
                continue
            kinds, k = np.unique(bx[:, -1], return_inverse=True)
            one = np.eye(len(kinds))[k]
            for s in range(0, len(ai), 500):
                m = METRICS["euclidean"](ax[s : s + 500, :-1], bx[:, :-1])
                i, c = np.meshgrid(ai[s : s + 500], kinds, indexing="ij")
                n = np.broadcast_to(one.sum(0), i.shape)
                mine = np.repeat(ax[s : s + 500, -1], len(kinds))
                out.append(pd.DataFrame({"id": i.ravel(), "mine": mine, "label": c.ravel(), "total": (m @ one).ravel(), "n": n.ravel().astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "mine": [], "label": [], "total": [], "n": []})

    s = _blocks(p)[0].groupBy("a", "b").applyInPandas(run, "id bigint, mine double, label double, total double, n bigint")
    s = s.groupBy("id", "mine", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("mine") == F.col("label")
    s = s.groupBy("id").agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    v = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.where("b IS NOT NULL").agg(F.avg(v).alias("silhouette"), F.count("*").alias("n"))


def calinski_harabasz(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(calinski_harabasz), one row: spread between clusters by spread within, each by its degrees of freedom. Null where undefined."""
    p = points.join(labels.select("id", "label"), "id").select("label", "id", F.posexplode("x").alias("k", "v"))
    c = p.groupBy("label", "k").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    w = c.groupBy("k").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum(F.col("n") * F.col("s")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.count("*").alias("k_n"))
    t = w.agg(F.sum(F.col("mm") - F.col("all") * F.col("g") * F.col("g")).alias("b"), F.sum("within").alias("w"), F.max("all").alias("n"), F.max("k_n").alias("c"))
    return t.select(F.try_divide(F.try_divide(F.col("b"), F.col("c") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("c"))).alias("calinski_harabasz"))


def outlines(points: DataFrame, partition: DataFrame) -> DataFrame:
    """(cid, num, hull): members of each part of plane points and the corners of their convex hull, counterclockwise from the leftmost; null for fewer than three places.

    Points are thinned by x and by strips before the hull of a part is drawn.
    """
    p = partition.join(points, partition["node"] == points["id"]).select("cid", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    n = p.groupBy("cid").agg(F.count("*").alias("num"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    strip = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)).otherwise(0)
    # Of the points of one x only the lowest and the highest can be corners; each strip is reduced to its own hull.
    ext = p.groupBy("cid", "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    ext = ext.join(n, "cid").withColumn("s", strip).select("cid", "s", "x", F.explode(F.array("a", "b")).alias("y"))
    ext = ext.groupBy("cid", "s").agg(F.collect_set(F.struct("x", "y")).alias("pts"))

    def corners(pts) -> list:
        pts = sorted({(q["x"], q["y"]) for q in pts})
        if len(pts) < 3:
            return pts
        half = []
        for seq in (pts, pts[::-1]):
            h: list = []
            for q in seq:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(q)
            half += h[:-1]
        return half

    def thin(batches):
        for d in batches:
            yield d.assign(pts=[[{"x": x, "y": y} for x, y in corners(v)] for v in d["pts"]])

    def join(d: pd.DataFrame) -> pd.DataFrame:
        c = corners([q for v in d["pts"] for q in v])
        return pd.DataFrame({"cid": [d["cid"].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in c] if len(c) > 2 else None]})

    thinned = ext.mapInPandas(thin, ext.schema)
    hull = thinned.groupBy("cid").applyInPandas(join, "cid bigint, hull array<struct<x:double,y:double>>")
    return n.select("cid", "num").join(hull, "cid")


#: Cells a radius, cells a side of the tiles in which they are looked at, and cells around that have a say.
FINE, TILE, HALO = 16, 128, 36


def _in_tiles(df: DataFrame, columns: list, size: float, halo: float) -> DataFrame:
    """df with each row in all tiles (t0, t1) of this size that it lies in or within the halo of."""
    for k, c in enumerate(columns):
        df = df.withColumn(f"t{k}", F.explode(F.sequence(F.floor((c - halo) / size), F.floor((c + halo) / size))))
    return df


def _discs(cells: np.ndarray, widths: list[int]) -> np.ndarray:
    """Which cells have one of the given cells within widths[k] columns in the k-th row above or below."""
    rows, columns = cells.shape
    out = np.zeros(cells.shape, bool)
    for k, w in enumerate(widths):
        sums = np.concatenate([np.zeros((rows, w + 1), np.int32), np.cumsum(np.pad(cells, ((0, 0), (0, w))), axis=1, dtype=np.int32)], axis=1)
        if w > 0:
            sums[:, w + 1 + columns :] = sums[:, [w + columns]]
        near = sums[:, 2 * w + 1 : 2 * w + 1 + columns] - sums[:, :columns] > 0
        out[k:] |= near[: rows - k]
        out[: rows - k] |= near[k:]
    return out


def _voids(d: pd.DataFrame, tile: tuple[int, int], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a tile and around it, by row and column: which have points, and in which a circle without points inside may have its centre.

    No circle round any place of a cell is empty if another cell lies within the radius of all its places and has points. The margin, a share of the radius squared, is that
    of rounding and of what counts as inside.
    """
    some = np.zeros((TILE + 2 * HALO, TILE + 2 * HALO), bool)
    some[d["c0"].to_numpy() - tile[0] * TILE + HALO, d["c1"].to_numpy() - tile[1] * TILE + HALO] = True
    inner = FINE * FINE * (1 - margin)
    return some, ~_discs(some, [math.floor(math.sqrt(inner - (k + 1) ** 2) - 1) for k in range(FINE) if (k + 1) ** 2 + 1 < inner])


#: Runs of the 64 directions round a point as bits, by first direction and length.
_RUNS = np.array([[sum(1 << (first + k) % 64 for k in range(n)) for n in range(65)] for first in range(64)], np.uint64)


def _surrounded(x: np.ndarray, y: np.ndarray, mine: np.ndarray, radius: float) -> np.ndarray:
    """Which of the points named are surely in no side: wherever the centre of a circle through them is, it holds an outermost point, in one of eight directions, of a cell
    that they lie in."""
    seen = np.zeros(len(mine), np.uint64)
    for width in (radius / 4, radius / 16, radius / 64, radius / 256):
        for shift in (0.0, 0.5):
            _, cell = np.unique(np.floor(x / width + shift) * 2.0**26 + np.floor(y / width + shift), return_inverse=True)
            order = np.argsort(cell, kind="stable")
            of = cell[order]
            first = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
            for turn in np.arange(8) * np.pi / 4:
                out = (x * np.cos(turn) + y * np.sin(turn))[order]
                most = out == np.maximum.reduceat(out, first)[of]
                pick = np.zeros(len(first), int)
                pick[of[most]] = order[most]
                other = pick[cell[mine]]
                dx, dy = x[other] - x[mine], y[other] - y[mine]
                d = np.sqrt(dx * dx + dy * dy)
                half = np.arccos(np.minimum(1, (d * d + 1e-9) / np.maximum(2 * radius * d, 1e-300))) - 1e-6
                to, step = np.arctan2(dy, dx), 2 * np.pi / 64
                lo = np.ceil((to - half) / step).astype(int)
                n = np.where(d > 0, np.maximum(np.floor((to + half) / step).astype(int) - lo, 0), 0)
                seen |= _RUNS[lo % 64, n]
    return seen == np.uint64(2**64 - 1)


def alpha_outlines(points: DataFrame, partition: DataFrame, radius: float) -> DataFrame:
    """(cid, num, u, v, x1, y1, x2, y2): the sides of each part's alpha shape: pairs of its plane points through which a circle of this radius goes that holds no other point of
    the part (u < v are ids; of points at one place the smallest stands for all). num is the number of the part's members.

    Points of one place are one corner, a point without any within two radii has no side. Points where no circle can be empty, as cells with points are all around, are
    left out first; the others meet in tiles. Of these, points surrounded by a few others are passed by; for the rest, those within two radii of a point cover the centres of
    the circles through it, and only pairs with a centre that is not covered are tried with all of these. A circle around a place where none can be empty is none: others have no point inside that was left out.
    """
    p = partition.join(points, partition["node"] == points["id"]).select("cid", "id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    num = p.groupBy("cid").agg(F.count("*").alias("num"))
    some = p.where("cid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    q = some.groupBy("cid", "x", "y").agg(F.min("id").alias("id")).withColumns({f"c{k}": F.floor(F.col(c) / (radius / FINE)) for k, c in enumerate("xy")})
    q = materialize(q, "outline-points")
    margin = 1e-7 + 1e-9 / (radius * radius)
    cells = _in_tiles(q.select("cid", "c0", "c1").distinct(), [F.col("c0"), F.col("c1")], TILE, HALO).groupBy("cid", "t0", "t1")

    def near_voids(d: pd.DataFrame) -> pd.DataFrame:
        tile = int(d["t0"].iloc[0]), int(d["t1"].iloc[0])
        some, free = _voids(d, tile, margin)
        outer = FINE * FINE * (1 + 1e-7)
        some &= _discs(free, [math.floor(math.sqrt(outer - max(k - 1, 0) ** 2) + 1) for k in range(FINE + 2)])
        i, j = np.nonzero(some[HALO : HALO + TILE, HALO : HALO + TILE])
        return pd.DataFrame({"cid": d["cid"].iloc[0], "c0": i + tile[0] * TILE, "c1": j + tile[1] * TILE})

    open_ = cells.applyInPandas(near_voids, "cid bigint, c0 bigint, c1 bigint")
    q = materialize(q.join(open_, ["cid", "c0", "c1"], "left_semi").select("cid", "id", "x", "y"), "outline-open")
    size, least = 4 * radius, radius * radius - 1e-9

    def sides(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("x")
        ids, x, y = d["id"].to_numpy(), d["x"].to_numpy(), d["y"].to_numpy()
        mine = (np.floor(x / size) == d["t0"].iloc[0]) & (np.floor(y / size) == d["t1"].iloc[0])
        first, last = np.searchsorted(x, x - 2.001 * radius), np.searchsorted(x, x + 2.001 * radius, "right")
        out: list[tuple[int, int, float, float]] = []
        mine = np.nonzero(mine)[0]
        for k in mine[~_surrounded(x, y, mine, radius)]:
            near = np.arange(first[k], last[k])
            dx, dy = x[near] - x[k], y[near] - y[k]
            dd = dx * dx + dy * dy
            ok = (np.sqrt(dd) <= 2 * radius) & (near != k)
            near, dx, dy, dd = near[ok], dx[ok], dy[ok], dd[ok]
            to, r = np.arctan2(dy, dx), np.sqrt(dd)
            # Each neighbour lies in the circles through the point whose centres are in this arc, cut a little against rounding.
            half = np.arccos(np.minimum(1, (dd + 1e-9) / (2 * radius * r))) - 1e-6
            some = half > 0
            lo = np.concatenate([(to - half)[some] + turn for turn in (-2 * np.pi, 0, 2 * np.pi)])
            hi = np.concatenate([(to + half)[some] + turn for turn in (-2 * np.pi, 0, 2 * np.pi)])
            order = np.argsort(lo)
            lo, hi = np.append(-np.inf, lo[order]), np.append(-np.inf, np.maximum.accumulate(hi[order]))
            ends = np.arccos(np.minimum(1, r / (2 * radius)))
            h = np.sqrt(np.maximum(0, radius * radius / dd - 0.25))
            maybe = [hi[np.searchsorted(lo, e) - 1] <= e for e in (to - ends, to + ends)]
            for n in np.nonzero((maybe[0] | maybe[1]) & (ids[near] > ids[k]))[0]:
                z = near[n]
                mx, my = (x[k] + x[z]) / 2, (y[k] + y[z]) / 2
                others = near[near != z]
                for sign in (1, -1):
                    cx, cy = mx - sign * dy[n] * h[n], my + sign * dx[n] * h[n]
                    if not ((x[others] - cx) ** 2 + (y[others] - cy) ** 2 < least).any():
                        out.append((k, z, cx, cy))
        u, v = np.array([o[:2] for o in out], int).reshape(-1, 2).T
        at = np.floor(np.array([o[2:] for o in out]).reshape(-1, 2) / (radius / FINE)).astype(int).T
        return pd.DataFrame({"cid": d["cid"].iloc[0], "u": ids[u], "v": ids[v], "x1": x[u], "y1": y[u], "x2": x[v], "y2": y[v], "c0": at[0], "c1": at[1]})

    def centred(e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return e[kept]
        tile = int(e["t0"].iloc[0]), int(e["t1"].iloc[0])
        free = _voids(d, tile, margin)[1]
        return e.loc[free[e["c0"].to_numpy() - tile[0] * TILE + HALO, e["c1"].to_numpy() - tile[1] * TILE + HALO], kept]

    tiles = _in_tiles(q, [F.col("x"), F.col("y")], size, 2.01 * radius)
    kept, types = ["cid", "u", "v", "x1", "y1", "x2", "y2"], "cid bigint, u bigint, v bigint, x1 double, y1 double, x2 double, y2 double"
    found = tiles.groupBy("cid", "t0", "t1").applyInPandas(sides, types + ", c0 bigint, c1 bigint")
    found = _in_tiles(found, [F.col("c0"), F.col("c1")], TILE, 0).groupBy("cid", "t0", "t1").cogroup(cells).applyInPandas(centred, types).distinct()
    return found.join(num, "cid").select("cid", "num", "u", "v", "x1", "y1", "x2", "y2")
