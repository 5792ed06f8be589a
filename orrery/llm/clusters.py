"""Similarity clusters of point records: chains of short steps, found in tiles with overlapping margins.

Vectors are reduced to integer cells so small that all points of a cell belong together; what a tile gets are boxes of points (a bounded number
per cell), never all points. Each tile links its cells and those lent to it from around; local clusters merge through the cells that tiles share.
Where boxes leave it open whether two cells touch, only those boxes are split further, until it is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.operators.components import connected_components
from orrery.operators.spatial import EARTH_RADIUS, haversine_column, lon_margin
from orrery.plans.scratch import materialize

#: Cells on a tile's side; halvings by 8 of a cell's side; halvings at which tiles look.
TILE, LEVELS, FIRST = 32, 7, 1
#: Rows of tiles that are solved together.
BATCH = 50_000


def _grid(points: DataFrame, eps: float) -> DataFrame:
    """(id, lon, lat, r, fi, fj): row of cells, and the finest places of latitude and longitude as whole numbers, nested by 3 bits a level."""
    side = eps / math.sqrt(2) * 0.999 / EARTH_RADIUS
    h = math.degrees(side)
    fine = 8**LEVELS
    p = points.where("id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    p = p.select("id", "lon", "lat", F.floor((F.col("lat") + 90) / h * fine).alias("fi"))
    p = p.withColumn("r", F.shiftright("fi", 3 * LEVELS))
    return p.withColumn("fj", F.floor((F.col("lon") + 180) / _cell_width(F.col("r"), h) * fine))


def _cell_width(r: Column, h: float) -> Column:
    """Degrees of longitude of the cells of a row: no wider than high where the row is widest. The row at a pole is one cell."""
    lo, hi = r * h - 90, (r + 1) * h - 90
    least = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return F.least(F.lit(720.0), h / F.cos(F.radians(F.least(least, F.lit(89.9999)))))


def _boxes(grid: DataFrame, level: int, *more: str) -> DataFrame:
    """The points by boxes of a level: number, smallest id and extent."""
    b = 3 * (LEVELS - level)
    g = grid.groupBy(*more, "r", F.shiftright("fi", b).alias("fi"), F.shiftright("fj", b).alias("fj"))
    return g.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.min("lon").alias("x1"), F.max("lon").alias("x2"), F.min("lat").alias("y1"), F.max("lat").alias("y2"))


def _bounds(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible metres between a point of box a and one of box b."""
    def metres(dy, dx, c1, c2):
        h = np.sin(np.radians(dy) / 2) ** 2 + c1 * c2 * np.sin(np.radians(np.minimum(dx, 180)) / 2) ** 2
        return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))

    def cosines(o):
        c1, c2 = np.cos(np.radians(o["y1"])), np.cos(np.radians(o["y2"]))
        return np.minimum(c1, c2), np.where((o["y1"] <= 0) & (o["y2"] >= 0), 1.0, np.maximum(c1, c2))

    (al, ah), (bl, bh) = cosines(a), cosines(b)
    near = metres(np.maximum(0, np.maximum(b["y1"] - a["y2"], a["y1"] - b["y2"])), np.maximum(0, np.maximum(b["x1"] - a["x2"], a["x1"] - b["x2"])), al, bl)
    far = metres(np.maximum(b["y2"] - a["y1"], a["y2"] - b["y1"]), np.maximum(b["x2"] - a["x1"], a["x2"] - b["x1"]), ah, bh)
    point = (a["x1"] == a["x2"]) & (a["y1"] == a["y2"]) & (b["x1"] == b["x2"]) & (b["y1"] == b["y2"])
    return np.where(point, far, near - 1e-6), far


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked with each index, by pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _local(t: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Whole tiles: 'cell' rows give each cell's smallest id with its local cluster's; 'open' rows pairs of boxes that may or may not touch."""
    t = t.reset_index(drop=True)
    tile = np.unique(t[["tr", "tc"]].to_numpy(), axis=0, return_inverse=True)[1].ravel()
    cell, first = np.unique(np.column_stack([tile, t[["r", "cj"]].to_numpy()]), axis=0, return_inverse=True)
    first = first.ravel()
    low = np.full(len(cell), np.iinfo(np.int64).max)
    np.minimum.at(low, first, t["low"].to_numpy())
    # Whole numbers from small ids upward, so that the least root is the least id.
    order = np.argsort(low, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    node = rank[first]
    box = {c: t[c].to_numpy() for c in ("x1", "x2", "y1", "y2")}
    reach = math.degrees(eps / EARTH_RADIUS) * 1.0001
    mid = (box["y1"] + box["y2"]) / 2
    south, far_lat = np.full(tile.max() + 1, 90.0), np.zeros(tile.max() + 1)
    np.minimum.at(south, tile, mid)
    np.maximum.at(far_lat, tile, np.abs(mid))
    wide = (reach / np.maximum(np.cos(np.radians(np.minimum(89.999, far_lat + 2 * reach))), 1e-9))[tile]
    wide[np.isin(tile, tile[t["polar"].to_numpy()])] = 720.0
    # One ascending number for all tiles: tile, band of latitude, longitude.
    x = (box["x1"] + box["x2"]) / 2
    half = (box["x2"] - box["x1"]).max() / 2
    band = tile.astype(np.int64) * 256 + np.floor((mid - south[tile]) / (2 * reach)).astype(np.int64)
    place = lambda band, x: (band << 34) + np.floor(np.clip(x + 800, 0, 1700) * 1e7).astype(np.int64)
    at = place(band, x)
    o = np.argsort(at, kind="stable")
    at = at[o]
    sure_a, sure_b, maybe = [], [], []
    for up in (0, 1, 2):
        span = wide + 2 * half + 3e-7
        lo, hi = np.searchsorted(at, place(band + up, x - span)), np.searchsorted(at, place(band + up, x + span), side="right")
        n = hi - lo
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, side="right")))
            k = n[a:b]
            i = np.repeat(np.arange(a, b), k)
            j = o[np.repeat(lo[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            ok = (node[i] != node[j]) & ((up > 0) | (i < j))
            i, j = i[ok], j[ok]
            near, far = _bounds({c: v[i] for c, v in box.items()}, {c: v[j] for c, v in box.items()})
            sure = far <= eps
            sure_a.append(node[i[sure]])
            sure_b.append(node[j[sure]])
            m = (near <= eps) & ~sure
            maybe.append(np.stack([i[m], j[m]], axis=1))
            a = b
    root = _roots(len(cell), np.concatenate(sure_a), np.concatenate(sure_b))
    m = np.concatenate(maybe)
    m = m[root[node[m[:, 0]]] != root[node[m[:, 1]]]]
    shared = np.zeros(len(cell), bool)
    home = np.zeros(len(cell), bool)
    np.logical_or.at(shared, first, t["shared"].to_numpy())
    np.logical_or.at(home, first, t["home"].to_numpy())
    label = low[order][root[rank]]
    cells = pd.DataFrame({"kind": "cell", "r": cell[:, 1], "cj": cell[:, 2], "low": low, "label": label, "shared": shared, "home": home})
    i, j = m[:, 0], m[:, 1]
    g = lambda c, k: t[c].to_numpy()[k]
    swap = (g("r", i) > g("r", j)) | ((g("r", i) == g("r", j)) & (g("fj", i) > g("fj", j)))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    opened = pd.DataFrame({"kind": "open", "r": g("r", i), "fi": g("fi", i), "fj": g("fj", i), "low": low[first[i]], "r_b": g("r", j), "fi_b": g("fi", j), "fj_b": g("fj", j), "label": low[first[j]], "shift": g("shift", j) - g("shift", i)})
    return pd.concat([cells, opened], ignore_index=True)


def _tiles_of(batches: Iterator[pd.DataFrame], eps: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile; as many whole tiles as BATCH rows hold are solved together."""
    kept: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        kept.append(b)
        n += len(b)
        if n >= BATCH:
            d = pd.concat(kept, ignore_index=True)
            last = ((d["tr"] == d["tr"].iloc[-1]) & (d["tc"] == d["tc"].iloc[-1])).to_numpy()
            if not last.all():
                yield _local(d[~last], eps)
            kept = [d[last]]
            n = int(last.sum())
    if n:
        yield _local(pd.concat(kept, ignore_index=True), eps)


_LOCAL = "kind string, r bigint, cj bigint, low bigint, label bigint, shared boolean, home boolean, fi bigint, fj bigint, r_b bigint, fi_b bigint, fj_b bigint, shift double"


def _tiles(grid: DataFrame, eps: float) -> DataFrame:
    """The boxes with (tr, tc): every box in its home tile and in each tile that has cells within reach of its cell."""
    h = math.degrees(eps / math.sqrt(2) * 0.999 / EARTH_RADIUS)
    b = _boxes(grid, FIRST).withColumn("cj", F.shiftright("fj", 3 * FIRST))
    w = _cell_width(F.col("r"), h)
    b = b.withColumn("w", w).withColumn("x", F.col("cj") * F.col("w"))
    polar = F.abs((F.col("r") + 0.5) * h - 90) > 89.9
    def tile(r: Column, x: Column) -> Column:
        tr = F.floor(r / TILE)
        width = TILE * _cell_width(tr * TILE + TILE // 2, h)
        return F.struct(tr.alias("tr"), F.when(F.abs((tr + 0.5) * TILE * h - 90) > 88, F.lit(0)).otherwise(F.floor(x / width)).cast("bigint").alias("tc"))

    reach = lon_margin(F.abs(F.col("r") * h - 90) + h, eps)
    lent = []
    for wrap in (0, 1, -1):
        for dr in (-2, 0, 2):
            for side in (F.col("x") - reach, F.col("x"), F.col("x") + F.col("w") + reach):
                x = side + 360.0 * wrap
                t = tile(F.col("r") + dr, x)
                t = F.struct(t["tr"].alias("tr"), t["tc"].alias("tc"), F.lit(360.0 * wrap).alias("shift"))
                lent.append(t if wrap == 0 else F.when((x >= -reach) & (x <= 360 + reach), t))
    b = b.withColumn("own", tile(F.col("r"), F.col("x"))).withColumn("t", F.array_compact(F.array_distinct(F.array(*lent))))
    b = b.withColumn("shared", F.size("t") > 1).withColumn("t", F.explode("t"))
    return b.select(
        F.col("t.tr").alias("tr"), F.col("t.tc").alias("tc"), F.col("t.shift").alias("shift"), "r", "cj", "fi", "fj", "low", (F.col("x1") + F.col("t.shift")).alias("x1"), (F.col("x2") + F.col("t.shift")).alias("x2"), "y1", "y2", "shared",
        ((F.col("t.tr") == F.col("own.tr")) & (F.col("t.tc") == F.col("own.tc")) & (F.col("t.shift") == 0)).alias("home"), polar.alias("polar"),
    )


def _decide(grid: DataFrame, opened: DataFrame, eps: float) -> DataFrame:
    """(u, v): the cells (by smallest id) of those open pairs of boxes that do touch. Open boxes are split by 8 x 8 until nothing is open."""
    links: DataFrame | None = None
    todo = opened.select("low", "label", "r", "fi", "fj", "r_b", "fi_b", "fj_b", "shift").distinct()
    for level in range(FIRST + 1, LEVELS + 1):
        todo = materialize(todo, "clusters-open")
        if todo.isEmpty():
            break
        b = 3 * (LEVELS - level)
        keys = todo.select("r", "fi", "fj").unionByName(todo.select(F.col("r_b").alias("r"), F.col("fi_b").alias("fi"), F.col("fj_b").alias("fj"))).distinct()
        inner = _boxes(grid, level).withColumn("pi", F.shiftright("fi", 3)).withColumn("pj", F.shiftright("fj", 3))
        inner = inner.join(keys.select("r", F.col("fi").alias("pi"), F.col("fj").alias("pj")), ["r", "pi", "pj"], "left_semi")
        a = inner.select(*[F.col(c).alias("a_" + c) for c in inner.columns])
        o = inner.select(*[F.col(c).alias("b_" + c) for c in inner.columns])
        p = todo.join(a, (F.col("a_r") == F.col("r")) & (F.col("a_pi") == F.col("fi")) & (F.col("a_pj") == F.col("fj")))
        p = p.join(o, (F.col("b_r") == F.col("r_b")) & (F.col("b_pi") == F.col("fi_b")) & (F.col("b_pj") == F.col("fj_b")))

        def judge(it, eps=eps, last=level == LEVELS):
            for d in it:
                box = lambda s, k=0.0, d=d: {"x1": d[s + "_x1"].to_numpy() + k, "x2": d[s + "_x2"].to_numpy() + k, "y1": d[s + "_y1"].to_numpy(), "y2": d[s + "_y2"].to_numpy()}
                near, far = _bounds(box("a"), box("b", d["shift"].to_numpy()))
                d = d.assign(sure=(far <= eps) | (last & (near <= eps)), maybe=near <= eps)
                yield d.loc[d["maybe"], ["low", "label", "a_r", "a_fi", "a_fj", "b_r", "b_fi", "b_fj", "shift", "sure"]]

        j = p.select("low", "label", "shift", *[f"{s}_{c}" for s in "ab" for c in ("r", "fi", "fj", "x1", "x2", "y1", "y2")])
        j = materialize(j.mapInPandas(judge, "low bigint, label bigint, a_r bigint, a_fi bigint, a_fj bigint, b_r bigint, b_fi bigint, b_fj bigint, shift double, sure boolean"), "clusters-judged")
        sure = j.where("sure").select(F.col("low").alias("u"), F.col("label").alias("v")).distinct()
        links = sure if links is None else links.unionByName(sure)
        rest = j.where("NOT sure").join(sure, (F.col("low") == F.col("u")) & (F.col("label") == F.col("v")), "left_anti")
        todo = rest.select("low", "label", F.col("a_r").alias("r"), F.col("a_fi").alias("fi"), F.col("a_fj").alias("fj"), F.col("b_r").alias("r_b"), F.col("b_fi").alias("fi_b"), F.col("b_fj").alias("fj_b"), "shift").distinct()
    empty = opened.select(F.col("low").alias("u"), F.col("label").alias("v")).where(F.lit(False))
    return empty if links is None else links


def _close(some: DataFrame, grid: DataFrame, eps: float) -> DataFrame:
    """(id, other): for some points of a grid all of its points within eps metres, themselves included. Each looks into the cells around it, row by row of cells."""
    h = math.degrees(eps / math.sqrt(2) * 0.999 / EARTH_RADIUS)
    margin = lon_margin(F.abs("lat") + 3 * h, eps)
    q = some.select("id", "lon", "lat", margin.alias("m"), F.explode(F.sequence(F.col("r") - 2, F.col("r") + 2)).alias("r"))
    q = q.select("id", "lon", "lat", "m", "r", F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0))).alias("wrap")).withColumn("x", F.col("lon") + F.col("wrap"))
    q = q.where((F.col("x") + F.col("m") >= -180) & (F.col("x") - F.col("m") <= 180))
    w = _cell_width(F.col("r"), h)
    lo, hi = F.greatest(F.lit(-180.0), F.col("x") - F.col("m")), F.least(F.lit(180.0), F.col("x") + F.col("m"))
    q = q.select("id", "lon", "lat", "r", F.explode(F.sequence(F.floor((lo + 180) / w), F.floor((hi + 180) / w))).alias("cj")).distinct()
    o = grid.select(F.col("id").alias("other"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), "r", F.shiftright("fj", 3 * LEVELS).alias("cj"))
    return q.join(o, ["r", "cj"]).where(haversine_column(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2")) <= eps).select("id", "other").distinct()


def core_points(grid: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, core): whether a point has at least so many points within eps metres, itself included.

    The points of a cell are all within eps of each other, so those of cells with that many are cores at once; only the points of other cells are compared, and of
    these each cell holds fewer than min_samples: so a crowded place costs no more than its points.
    """
    cell = ["r", F.shiftright("fj", 3 * LEVELS).alias("cj")]
    n = grid.select(*cell).groupBy("r", "cj").agg(F.count("*").alias("n"))
    full = grid.select("*", cell[1]).join(n, ["r", "cj"])
    few = materialize(full.where(F.col("n") < min_samples).select(*grid.columns), "clusters-few")
    counted = _close(few, grid, eps).groupBy("id").agg((F.count("*") >= min_samples).alias("core"))
    return full.where(F.col("n") >= min_samples).select("id", F.lit(True).alias("core")).unionByName(counted)


def density_clusters(points: DataFrame, eps: float, min_samples: int, least: int = 1) -> DataFrame:
    """(id, cluster_id): density clusters of at least `least` points: cores, which have min_samples points within eps metres, themselves included, belong together when they are
    linked by steps of at most eps; other points within eps of a core join the cluster with the smallest id. cluster_id is the smallest core's id. Noise has no row.

    points as in clusters(), with which min_samples = 1 agrees: then every point is a core.
    """
    g = materialize(_grid(points, eps), "clusters-grid")
    core = materialize(core_points(g, eps, min_samples), "clusters-core")
    cores = materialize(g.join(core.where("core"), "id", "left_semi"), "clusters-cores")
    inner = materialize(clusters(cores, eps, 1), "clusters-inner")
    border = g.join(core.where("NOT core"), "id", "left_semi")
    outer = _close(border, cores, eps).join(inner.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    all_ = materialize(inner.unionByName(outer), "clusters-all")
    if least <= 1:
        return all_
    large = all_.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster_id")
    return all_.join(large, "cluster_id", "left_semi").select("id", "cluster_id")


def clusters(points: DataFrame, eps: float = 60.0, least: int = 5) -> DataFrame:
    """(id, cluster_id): the points of all groups of at least `least` ids linked by steps of at most eps metres; cluster_id is the smallest id. It is density_clusters() with
    min_samples = 1: all points are cores, and local clusters merge through the cells of cores that tiles share.

    points (id BIGINT, lon, lat), one row per id. Rows with a null or NaN in any of them are in no group; equal places are one step apart at
    0 m; further columns are ignored; no points give no rows. Distances are certain to a hundredth of a millimetre: of points whose boxes are split to that size and still may or may
    not be within eps, the link counts.
    """
    g = _grid(points, eps)
    g = materialize(g, "clusters-grid")
    parts = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = _tiles(g, eps).repartition(parts, "tr", "tc").sortWithinPartitions("tr", "tc")
    local = tiles.mapInPandas(lambda it: _tiles_of(it, eps), _LOCAL)
    local = materialize(local, "clusters-local")
    cells = local.where("kind = 'cell'")
    open_ = local.where("kind = 'open'")
    edges = cells.where("shared").select(F.col("low").alias("u"), F.col("label").alias("v"))
    extra = _decide(g, open_, eps)
    # An open pair names cells; link their local clusters in every tile through the cells themselves.
    touched = extra.select(F.col("u").alias("low")).unionByName(extra.select(F.col("v").alias("low"))).distinct()
    edges = edges.unionByName(extra).unionByName(cells.join(touched, "low", "left_semi").select(F.col("low").alias("u"), F.col("label").alias("v")))
    comp = connected_components(edges)
    home = cells.where("home").select("r", "cj", "label")
    home = home.join(comp.select(F.col("node").alias("label"), "component"), "label", "left").select("r", "cj", F.coalesce("component", "label").alias("cluster_id"))
    n = _boxes(g, 0).select("r", F.col("fj").alias("cj"), "n")
    sized = home.join(n, ["r", "cj"])
    large = sized.groupBy("cluster_id").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    home = sized.join(large, "cluster_id").select("r", "cj", "cluster_id")
    p = g.select("id", "r", F.shiftright("fj", 3 * LEVELS).alias("cj"))
    return p.join(home, ["r", "cj"]).select("id", "cluster_id")


def describe(points: DataFrame, members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, medoids): size of each cluster and its most typical ids, the most typical first.

    The typical members are those with the least sum of squared straight distances to all members, which are those nearest to their mean: so
    medoids take one pass. Equal ones: the smaller id first.
    """
    lon, lat = F.radians("lon"), F.radians("lat")
    p = members.join(points.select("id", "lon", "lat"), "id").select("id", "cluster_id", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    mean = p.groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(c).alias("m" + c) for c in "xyz"])
    d = p.join(mean, "cluster_id").withColumn("d", F.expr("round(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2), 18)"))
    top = d.withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("d", "id"))).where(F.col("k") <= typical)
    return top.groupBy("cluster_id").agg(F.first("size").alias("size"), F.expr("transform(sort_array(collect_list(struct(k, id))), s -> s.id)").alias("medoids"))
