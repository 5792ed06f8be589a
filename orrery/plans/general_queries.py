"""Queries of the general record operators over the project's tables, with SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import nested, orphans, spatial
from orrery.plans.scratch import materialize
from orrery.sources.tables import in_force, places, table, whole_number


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    return in_force(table(spark, d, "osm_raw"), "rec_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References of nested elements in the uploads."""
    nodes = nested.shred(_uploads(spark, d), levels=("nd",))
    return nested.references(nodes).select("rec_id", "parent_id", "elem_id", "pos", "ref").distinct()


def p3_elements(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of all objects and lists, with their parents' surrogate keys and ids."""
    n = nested.shred(_uploads(spark, d)).where("kind IN ('object', 'list')")
    return n.select("rec_id", "path", "parent_path", "field", "key", "ordinal", F.col("depth").cast("bigint").alias("depth"), "id", F.coalesce("owner_id", "above_id").alias("parent_id"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The records by whether they can be read, with the number of their rows in all tables."""
    n = nested.shred(_uploads(spark, d)).groupBy("rec_id").agg(F.max(F.when(F.col("path") == "$", F.col("kind"))).alias("kind"), F.count("*").alias("n"))
    return n.groupBy("kind").agg(F.count("*").alias("records"), F.sum("n").alias("rows"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The table of the array level `members`, typed by the merged schema."""
    return nested.tables(materialize(nested.shred(_uploads(spark, d)), "nested"))["members"]


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema: the array levels, their members and their types."""
    return nested.merged_schema(nested.shred(_uploads(spark, d)))


def versions_and_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    node, way, x, e = (table(spark, d, t) for t in ("osm_node", "osm_way", "x_shp", "edge_shp"))
    versions = orphans.parents(node, "osm_way", F.col("_id"), "loaded_at", dead=~F.col("visible")).unionByName(
        orphans.parents(x, "edge_shp", whole_number(F.col("id")), "loaded_at", dropped_at="dropped_at")
    )
    refs = way.select(F.lit("osm_way").alias("src"), F.col("_id").alias("owner_id"), F.explode("nd._ref").alias("key"), F.col("loaded_at").alias("t")).unionByName(
        e.select(F.lit("edge_shp").alias("src"), F.col("edgeid").alias("owner_id"), F.explode(F.array("u", "v")).alias("key"), F.col("loaded_at").alias("t"))
    )
    return versions, refs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target when they are loaded, per table and month."""
    o = orphans.ledger(*versions_and_refs(spark, d), "year")[0]
    return o.select(F.col("src").alias("src_table"), "ym", "owner_id", F.col("key").alias("ref")).distinct()


def p4_pending(spark: SparkSession, d: str) -> DataFrame:
    """Per table and month: new orphans, and references that wait at its end."""
    n = orphans.ledger(*versions_and_refs(spark, d), "month")[1]
    return n.select(F.col("src").alias("src_table"), F.date_format("ends", "yyyy-MM").alias("ym"), "new_orphans", "resolved", "reopened", "open_at_end")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records at most 25 m apart, and the regions of each."""
    p = places(table(spark, d, "x_shp"))
    near = spatial.near_pairs(p, 25.0).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = spatial.regions_of(p, table(spark, d, "ring")).select(F.lit("inside").alias("kind"), F.col("ring_id").alias("id_a"), F.col("id").alias("id_b"))
    return near.unionByName(inside)


QUERIES = {f.__name__: f for f in (p3_found, p3_elements, p3_records, p3_members, p3_schema, p4_found, p4_pending, p5_found)}

PLACES_SQL = """
raw AS (SELECT try_cast(trim(id) AS bigint) AS id, lon, lat, geometry.x AS x, geometry.y AS y, srid, loaded_at FROM x_shp),
latest AS (SELECT DISTINCT * FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rk FROM raw WHERE id IS NOT NULL) WHERE rk = 1),
deg AS (SELECT id, lon, lat, CASE WHEN srid = 3857 THEN degrees(x / 6378137.0) WHEN srid = 4326 THEN x END AS gx,
    CASE WHEN srid = 3857 THEN degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2) WHEN srid = 4326 THEN y END AS gy, NOT (x = 0 AND y = 0) AS has_xy FROM latest),
place AS (SELECT id, CASE WHEN abs(lon) <= 180 AND abs(lat) <= 90 AND NOT isnan(lon) AND NOT isnan(lat) AND NOT (lon = 0 AND lat = 0) THEN lon
      WHEN has_xy AND abs(gx) <= 180 AND abs(gy) <= 90 THEN gx END AS lon,
    CASE WHEN abs(lon) <= 180 AND abs(lat) <= 90 AND NOT isnan(lon) AND NOT isnan(lat) AND NOT (lon = 0 AND lat = 0) THEN lat
      WHEN has_xy AND abs(gx) <= 180 AND abs(gy) <= 90 THEN gy END AS lat FROM deg),
places AS (SELECT * FROM place WHERE lon IS NOT NULL)
"""

EVENTS_SQL = """
refs AS (
  SELECT DISTINCT 'osm_way' AS src, owner_id, key, t FROM (SELECT _id AS owner_id, unnest(nd)._ref AS key, loaded_at AS t FROM osm_way) WHERE key IS NOT NULL
  UNION ALL SELECT DISTINCT 'edge_shp', owner_id, key, t FROM (SELECT edgeid AS owner_id, unnest([u, v]) AS key, loaded_at AS t FROM edge_shp) WHERE key IS NOT NULL),
versions AS (
  SELECT DISTINCT 'osm_way' AS src, _id AS key, loaded_at AS at, coalesce(NOT visible, false) AS dead, CAST(NULL AS timestamp) AS dropped FROM osm_node
  UNION ALL SELECT DISTINCT 'edge_shp', try_cast(trim(id) AS bigint), loaded_at, false, dropped_at FROM x_shp)
"""

_JUDGED = """judged AS (
  SELECT r.src, r.owner_id, r.key, r.t, v.key IS NULL OR v.dead OR coalesce(v.dropped <= r.t, false) AS orphan
  FROM refs r ASOF LEFT JOIN versions v ON r.src = v.src AND r.key = v.key AND r.t >= v.at)"""

SQL = {
    "p4_pending": f"""WITH {EVENTS_SQL}, {_JUDGED},
times AS (SELECT src, date_trunc('month', t) AS m FROM refs UNION SELECT src, date_trunc('month', versions.at) FROM versions WHERE key IS NOT NULL),
months AS (SELECT m, m + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS e FROM (SELECT DISTINCT m FROM times)),
grid AS (SELECT * FROM (SELECT DISTINCT src, key FROM refs), months),
states AS (SELECT g.src, g.key, g.m, v.key IS NULL OR v.dead OR coalesce(v.dropped <= g.e, false) AS open
  FROM grid g ASOF LEFT JOIN versions v ON g.src = v.src AND g.key = v.key AND g.e >= v.at),
n AS (SELECT src, key, date_trunc('month', t) AS m, count(*) AS c FROM refs GROUP BY ALL),
runs AS (SELECT src, m, open, lag(open) OVER w AS was, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER w AS n FROM states LEFT JOIN n USING (src, key, m) WINDOW w AS (PARTITION BY src, key ORDER BY m)),
counts AS (SELECT src, m, sum(CASE WHEN was AND NOT open THEN n - c ELSE 0 END) AS resolved, sum(CASE WHEN NOT was AND open THEN n - c ELSE 0 END) AS reopened, sum(CASE WHEN open THEN n ELSE 0 END) AS open_at_end FROM runs GROUP BY ALL),
born AS (SELECT src, date_trunc('month', t) AS m, count(*) AS new_orphans FROM judged WHERE orphan GROUP BY ALL)
SELECT src AS src_table, strftime(m, '%Y-%m') AS ym, coalesce(new_orphans, 0) AS new_orphans, CAST(resolved AS bigint) AS resolved, CAST(reopened AS bigint) AS reopened, CAST(open_at_end AS bigint) AS open_at_end
FROM counts LEFT JOIN born USING (src, m) WHERE m >= (SELECT min(t.m) FROM times t WHERE t.src = counts.src)""",
    "p4_found": f"""WITH {EVENTS_SQL}, {_JUDGED}
SELECT DISTINCT src AS src_table, strftime(t, '%Y-%m') AS ym, owner_id, key AS ref FROM judged WHERE orphan""",
    "p5_found": f"""WITH {PLACES_SQL}, near AS (
  SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM places a JOIN places b ON a.id <> b.id AND b.lat BETWEEN a.lat AND a.lat + 0.0003 AND (b.lat > a.lat OR b.id > a.id)
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 25),
v AS (SELECT DISTINCT * FROM ring WHERE x IS NOT NULL AND y IS NOT NULL),
sides AS (SELECT ring_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring_id, part_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
inside AS (SELECT ring_id, id FROM places JOIN sides ON y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) GROUP BY ring_id, id HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT 'inside', ring_id, id FROM inside""",
}
