"""Points near other points, and the regions that points lie in.

Near pairs: latitude is cut into strips little higher than the distance; a strip is lent the points just above it. Crowded strips are
cut into segments of longitude by their number of points, and each is lent the points just right of it. Rows are partitioned by ranges of strip and segment; every
task sorts its own by longitude and sweeps an active set of the last few longitudes. A pair belongs to the lower strip and, in
it, to the left segment, so it comes out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.scratch import materialize

EARTH_RADIUS = 6371008.8
#: Pairs that one step of the sweep compares; points from which on a strip is cut into segments of about so many; most sides of rings that are sent to all executors.
BLOCK_PAIRS, SEGMENT_POINTS, MOST_SIDES = 1_000_000, 20_000, 200_000


def haversine_m(lon1, lat1, lon2, lat2):
    """Great-circle metres between places in degrees (NumPy arrays or numbers)."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def haversine_column(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The same as an expression over columns."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def lat_margin(metres: float) -> float:
    return math.degrees(metres / EARTH_RADIUS) * 1.000001 + 1e-9


def lon_margin(lat: Column, metres: float) -> Column:
    """Degrees of longitude within which all places lie that are at most so far from a place of this latitude; 360 near a pole."""
    ang = metres / EARTH_RADIUS * 1.000001
    far = F.abs(lat) + math.degrees(ang)
    return F.when(far >= 89.999, 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(ang / 2) / F.cos(F.radians(far))))) * 1.000001 + 1e-9)


def strips(points: DataFrame, metres: float) -> DataFrame:
    """(id, lon, lat, strip, seg, up, right, wrap, margin): every point where it is at home (up = right = 0) and where it is lent to.

    wrap = 1 marks copies of places near longitude -180 that stand right of 180.
    """
    dlat = lat_margin(metres)
    height = 2 * dlat
    p = points.where("id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select("id", "lon", "lat", F.floor(F.col("lat") / height).alias("s"))
    lent = F.when(F.col("lat") - F.col("s") * height <= dlat, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    p = p.select("id", "lon", "lat", "s", F.explode(lent).alias("up")).withColumn("strip", F.col("s") - F.col("up"))
    edge = F.greatest(F.abs(F.col("strip") * height), F.abs((F.col("strip") + 1) * height)) + dlat
    p = p.withColumn("margin", lon_margin(edge, metres))
    p = p.select("id", "lon", "lat", "strip", "up", "margin", F.explode(F.expr("CASE WHEN lon - margin < -180 THEN array(0, 1) ELSE array(0) END")).alias("wrap"))
    p = p.withColumn("lon", F.col("lon") + 360 * F.col("wrap"))
    # Cells of two margins: the points of one are near each other, so that however many they are, their pairs are the result.
    width = 2 * F.col("margin")
    p = p.withColumn("c", F.floor((F.col("lon") + 180) / width)).withColumn("c2", F.floor((F.col("lon") + 180 - F.col("margin")) / width))
    p = materialize(p, "strips")
    crowded = p.groupBy("strip").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT_POINTS).select("strip", F.lit(True).alias("crowded"))
    p = p.join(crowded, "strip", "left")
    cells = p.where("crowded").groupBy("strip", "c").agg(F.count("*").alias("n"))
    left = F.sum("n").over(W.partitionBy("strip").orderBy("c")) - F.col("n")
    cells = cells.select("strip", F.col("c").alias("cell"), F.floor(left / SEGMENT_POINTS).alias("seg"))
    p = p.withColumn("cell", F.explode(F.when(F.col("crowded"), F.array_distinct(F.array("c", "c2"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    p = p.withColumn("right", F.when(F.col("crowded") & (F.col("cell") != F.col("c")), 1).otherwise(0))
    p = p.join(cells, ["strip", "cell"], "left").where("crowded IS NULL OR seg IS NOT NULL")
    return p.select("id", "lon", "lat", "strip", F.coalesce("seg", F.lit(0)).alias("seg"), "up", "right", "wrap", "margin")


def _sweep(batches: Iterator[pd.DataFrame], metres: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by strip, seg, lon. The active set is what the next rows may still pair with."""
    dlat = lat_margin(metres)
    active: pd.DataFrame | None = None
    for new in batches:
        if not len(new):
            continue
        old = 0 if active is None else len(active)
        d = new if active is None else pd.concat([active, new], ignore_index=True)
        # A row lent to the segment in which it is at home anyway follows the one that is at home.
        same = np.logical_and.reduce([(v := d[c].to_numpy())[1:] == v[:-1] for c in ("strip", "seg", "lon", "id", "wrap")])
        if same.any():
            d = d[np.concatenate([[True], ~same])].reset_index(drop=True)
        strip, seg, lon, lat, ids = (d[c].to_numpy() for c in ("strip", "seg", "lon", "lat", "id"))
        margin, wide = d["margin"].to_numpy(), d["margin"].to_numpy() >= 180
        flags = d["up"].to_numpy().astype(np.int8) + 2 * d["right"].to_numpy().astype(np.int8) + 4 * d["wrap"].to_numpy().astype(np.int8)
        group = np.zeros(len(d))
        group[1:] = np.cumsum((strip[1:] != strip[:-1]) | (seg[1:] != seg[:-1]))
        at = group * 4096 + lon  # one ascending number for all groups of the batch
        # For each new row, the earlier rows of its group not further left than the margin.
        second = np.arange(old, len(d))
        first = np.searchsorted(at, at[second] - np.minimum(margin[second], 1000) - 1e-7)
        n = second - first
        n[n < 0] = 0
        ends = np.cumsum(n)
        a = 0
        while a < len(second):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_PAIRS, side="right")))
            k = n[a:b]
            if k.sum():
                j = np.repeat(second[a:b], k)
                i = np.repeat(first[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                ok = (np.abs(lat[i] - lat[j]) <= dlat) & ((flags[i] & flags[j]) == 0) & (ids[i] != ids[j]) & (group[i] == group[j])
                i, j = i[ok], j[ok]
                ok = haversine_m(lon[i], lat[i], lon[j], lat[j]) <= metres
                i, j = i[ok], j[ok]
                if len(i):
                    yield pd.DataFrame({"id_a": np.minimum(ids[i], ids[j]), "id_b": np.maximum(ids[i], ids[j]), "again": wide[i]})
            a = b
        keep = (group == group[-1]) & (lon >= lon[-1] - margin - 1e-7)
        active = d[keep]


def near_pairs(points: DataFrame, metres: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of points at most so many metres apart, each once.

    points (id BIGINT, lon, lat in degrees), one row per id; rows with a null or NaN in any of them have no pairs; further columns are ignored.
    Places that are equal are 0 m apart and pair. No points give no pairs.
    """
    p = strips(points, metres)
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A range ends with a whole segment, as its borders are values of both columns.
    p = p.repartitionByRange(n, "strip", "seg").sortWithinPartitions("strip", "seg", "lon", "id", "wrap", "right")
    out = p.mapInPandas(lambda it: _sweep(it, metres), "id_a bigint, id_b bigint, again boolean")
    # Only around the poles a pair may be met in either direction.
    return out.where("NOT again").select("id_a", "id_b").unionByName(out.where("again").select("id_a", "id_b").distinct())


def ring_edges(ring: DataFrame) -> DataFrame:
    """(ring_id, x1, y1, x2, y2, box): the sides of all parts, closed, with the box of the whole ring. Copied vertices count once; vertices with nulls go."""
    v = ring.select("ring_id", "part_no", "seq", "x", "y").dropna().distinct()
    w = W.partitionBy("ring_id", "part_no").orderBy("seq", "x", "y")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = v.select("ring_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"))
    box = v.groupBy("ring_id").agg(F.min("x").alias("xl"), F.max("x").alias("xh"))
    return e.where("y1 <> y2").join(box, "ring_id")


def regions_of(points: DataFrame, ring: DataFrame, band: float = 0.05) -> DataFrame:
    """(ring_id, id): the regions that each point lies in: those of which an odd number of sides crosses the ray to its east.

    ring (ring_id, part_no, seq, x, y): parts are closed lines; a point within an odd number of the parts is inside. A side counts from its lower
    end (included) to its upper (excluded). Points with nulls or NaN lie nowhere. Either side may be empty.
    Sides are looked up by bands of latitude: no point meets the sides of other latitudes. Up to MOST_SIDES pieces of sides go to all executors, so that points stay where
    they are and no band is in one task; of more rings, points and sides are shuffled by band, and crowded bands are left to the engine's splitting of skewed joins.
    """
    e = ring_edges(ring)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("band", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))))
    e = materialize(e, "ring-sides")
    if e.limit(MOST_SIDES + 1).count() <= MOST_SIDES:
        e = F.broadcast(e)
    p = points.where("id IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select("id", "lon", "lat", F.floor(F.col("lat") / band).alias("band"))
    lon, lat = F.col("lon"), F.col("lat")
    x = F.col("x1") + (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hit = p.join(e, "band").where((lon >= F.col("xl")) & (lon <= F.col("xh")) & (lo <= lat) & (lat < hi) & (lon < x))
    return hit.groupBy("ring_id", "id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("ring_id", "id")
