"""Queries of the corpus operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from orrery.llm import clusters, mixing, pii, similar, tokens
from orrery.plans.scratch import materialize
from orrery.plans.general_queries import PLACES_SQL
from orrery.sources.tables import in_force, places, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the groups of at least 5 records linked by steps of at most 60 m."""
    return clusters.clusters(places(table(spark, d, "x_shp")), 60.0, 5)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and its three most typical ids."""
    p = places(table(spark, d, "x_shp"))
    return clusters.describe(p, clusters.clusters(p, 60.0, 5), 3)


def p1_dense(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of records: cores with at least 5 records within 60 m, and what is within 60 m of one."""
    return clusters.density_clusters(places(table(spark, d, "x_shp")), 60.0, 5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points with a cosine of at least 0.9, each among the other's five most similar."""
    best = similar.similar(in_force(table(spark, d, "points"), "id"), 48, 5, 0.9, copies=False)
    pairs = best.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.count("*").alias("n"))
    return pairs.where("n = 2").select("id_a", "id_b")


def p2_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar points of each, with a cosine of at least 0.9."""
    return similar.similar(in_force(table(spark, d, "points"), "id"), 48, 5, 0.9)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text, decoded from its ids."""
    return tokens.decode(p6_ids(spark, d))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mix(materialize(docs.select("doc_id", "source", "n_tokens"), "mix-sizes"), table(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in the order of training: one row for each use of a document."""
    return mixing.in_order(_mixture(spark, d)[0])


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and reached share of each source."""
    return _mixture(spark, d)[1]


#: The key of the queries' surrogates; real runs give their own.
KEY = "surrogates of the public queries"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in the texts: kind and first character."""
    return pii.detect(table(spark, d, "documents"), table(spark, d, "given_name")).select("doc_id", "kind", "start_pos").distinct()


def p8_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed surrogates."""
    return pii.pseudonymize(table(spark, d, "documents"), table(spark, d, "given_name"), KEY)


def p8_collisions(spark: SparkSession, d: str) -> DataFrame:
    """How many surrogates had to be drawn again, per pool."""
    return pii.collisions(table(spark, d, "documents"), table(spark, d, "given_name"), KEY)


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p1_dense, p2_found, p2_similar, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_replaced, p8_collisions)}
_STEPS = f"""WITH RECURSIVE {PLACES_SQL}, near AS (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON b.lat BETWEEN a.lat - 0.0006 AND a.lat + 0.0006
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 60),
reach(node, root) AS (SELECT a, a FROM near UNION SELECT b, root FROM reach JOIN near ON node = a AND root < b), comp AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node)"""
#: Where SQL can say it. Texts come back as they were, null ones as the empty text.
_NEAR60 = _STEPS[: _STEPS.index("reach(")] + """both_ AS (SELECT a AS id, b AS o FROM near WHERE a <> b), core AS (SELECT id FROM both_ GROUP BY id HAVING count(*) + 1 >= 5),
links AS (SELECT id AS a, o AS b FROM both_ WHERE id IN (SELECT id FROM core) AND o IN (SELECT id FROM core) UNION SELECT id, id FROM core),
reach(node, root) AS (SELECT a, a FROM links UNION SELECT b, root FROM reach JOIN links ON node = a AND root < b), comp AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node)"""
SQL = {
    "p1_dense": _NEAR60 + " SELECT node AS id, cluster_id FROM comp UNION ALL SELECT id, min(cluster_id) FROM both_ JOIN comp ON o = node WHERE id NOT IN (SELECT id FROM core) GROUP BY id",
    "p1_found": _STEPS + " SELECT node AS id, cluster_id FROM comp WHERE cluster_id IN (SELECT cluster_id FROM comp GROUP BY cluster_id HAVING count(*) >= 5)",
    "p2_found": """WITH latest AS (SELECT DISTINCT id, x FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rk FROM points WHERE id IS NOT NULL) WHERE rk = 1),
ok AS (SELECT id, x FROM latest WHERE len(x) = 48 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
unit AS (SELECT id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS x FROM ok),
pairs AS (SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])), 12) AS s FROM unit a JOIN unit b ON a.id < b.id),
both_ AS (SELECT a, b, s FROM pairs WHERE s >= 0.9 UNION ALL SELECT b, a, s FROM pairs WHERE s >= 0.9),
best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rk FROM both_) WHERE rk <= 5)
SELECT x.a AS id_a, x.b AS id_b FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p2_similar": """WITH latest AS (SELECT DISTINCT id, x FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rk FROM points WHERE id IS NOT NULL) WHERE rk = 1),
ok AS (SELECT id, x FROM latest WHERE len(x) = 48 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
unit AS (SELECT id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS x FROM ok),
pairs AS (SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])), 12) AS s FROM unit a JOIN unit b ON a.id < b.id),
both_ AS (SELECT a, b, s FROM pairs WHERE s >= 0.9 UNION ALL SELECT b, a, s FROM pairs WHERE s >= 0.9),
best AS (SELECT a, b, s, rk FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rk FROM both_) WHERE rk <= 5)
SELECT a AS id, b AS other, s AS similarity, CAST(rk AS INT) AS rank FROM best""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
