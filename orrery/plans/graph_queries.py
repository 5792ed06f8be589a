"""Queries of the graph operators over the project's tables, with SQL that checks them where SQL can.

Graphs: trade (nations linked by line items between customers and suppliers of different nations, parts = regions), shp (the weighted edges of edge_shp, parts = hundreds
of ids), roads (osm_way) and graphs of the embeddings. Values are rounded to 6 digits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions import metrics, projection
from orrery.operators import dynamics, entropy, estimator, graphs, partition, priors, quality, spatial
from orrery.operators.components import connected_components
from orrery.plans.general_queries import PLACES_SQL
from orrery.sources import osm, shapefile
from orrery.sources.tables import places, table, whole_number

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- the graphs


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("c_nationkey").cast("bigint"), F.col("s_nationkey").cast("bigint")
    e = j.where(a != b).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.count("*").cast("double").alias("w"))
    p = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_regionkey").cast("bigint").alias("cid"))
    return e, p


def shp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = entropy.clean_edges(table(spark, d, "edge_shp"), w="weight", key="edgeid")
    n = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return e, n.select("node", F.floor(F.col("node") / 100).alias("cid"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return graphs.clean_points(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def near_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.radius_graph(vectors(spark, d), 1.2).select("u", "v", "w")


def roads(spark: SparkSession, d: str) -> DataFrame:
    return osm.road_graph(table(spark, d, "osm_way"))


def user_series(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): each user's sum of values per day, over all days. Events without a time add to no day; where none has one there are no days and no series."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    days = e.agg(F.min("day").alias("first"), F.datediff(F.max("day"), F.min("day")).alias("n"))
    s = e.groupBy("user_id", "day").agg(F.sum("value").alias("s"))
    timed = F.when(F.col("day").isNotNull(), F.struct("day", "s"))
    s = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(timed)).alias("m")).join(F.broadcast(days.where("n IS NOT NULL")))
    x = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.coalesce(F.try_element_at("m", F.date_add("first", k)), F.lit(0.0)))
    return s.select(F.col("user_id").alias("id"), x.alias("x"))


G = """trade AS (SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
shp_rows AS (SELECT DISTINCT edgeid, u, v, weight FROM (SELECT *, rank() OVER (PARTITION BY edgeid ORDER BY loaded_at DESC) AS rk FROM edge_shp WHERE edgeid IS NOT NULL) WHERE rk = 1),
shp AS (SELECT least(u, v) AS u, greatest(u, v) AS v, sum(weight) AS w FROM shp_rows WHERE u IS NOT NULL AND v IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND NOT isinf(weight) GROUP BY 1, 2)"""


def _graph_sql(graph: str) -> str:
    part = "SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS cid FROM nation" if graph == "trade" else "SELECT node, CAST(floor(node / 100) AS BIGINT) AS cid FROM (SELECT u AS node FROM shp UNION SELECT v FROM shp)"
    return f"""WITH {G}, part AS ({part}),
inc AS (SELECT u AS node, w FROM {graph} UNION ALL SELECT v, w FROM {graph}), deg AS (SELECT node, sum(w) AS degree, count(*) AS k FROM inc GROUP BY node),
ends AS (SELECT a.cid, b.cid AS other, w FROM {graph} JOIN part a ON u = a.node JOIN part b ON v = b.node UNION ALL SELECT b.cid, a.cid, w FROM {graph} JOIN part a ON u = a.node JOIN part b ON v = b.node),
stats AS (SELECT cid, sum(w) AS vol, CAST(sum(CASE WHEN cid <> other THEN 1 ELSE 0 END) AS BIGINT) AS cut_count, sum(CASE WHEN cid <> other THEN w ELSE 0.0 END) AS cut_weight FROM ends GROUP BY cid),
tot AS (SELECT sum(vol) AS total FROM stats),
btw AS (SELECT cid AS ci, other AS cj, count(*) AS mc, sum(w) AS mw FROM ends WHERE cid < other GROUP BY 1, 2),
pr AS (SELECT a.cid AS ci, b.cid AS cj, a.vol AS vi, b.vol AS vj, a.vol + b.vol AS vij, a.cut_count AS ci_g, b.cut_count AS cj_g, a.cut_weight AS wi_g, b.cut_weight AS wj_g,
  coalesce(mc, 0) AS mc, coalesce(mw, 0) AS mw, total FROM stats a JOIN stats b ON a.cid < b.cid LEFT JOIN btw ON btw.ci = a.cid AND btw.cj = b.cid, tot) """


T, S = _graph_sql("trade"), _graph_sql("shp")
H2 = """SELECT round(log2(total) - dv / total, 6) + 0.0 AS h1, round((pv - dv - gv + g * log2(total)) / total, 6) + 0.0 AS h2, round(log2(total) - dv / total - (pv - dv - gv + g * log2(total)) / total, 6) + 0.0 AS di
FROM (SELECT sum(vol) AS total, sum(vol * log2(vol)) AS pv, sum(cut_weight) AS g, sum(cut_weight * log2(vol)) AS gv FROM stats), (SELECT sum(degree * log2(degree)) AS dv FROM deg)"""
E12 = "(-(vi - gi) * log2(vi) - (vj - gj) * log2(vj) + (vij - gij) * log2(vij) + (vi + vj - vij - gi - gj + gij) * log2(total)) / total"
_one = "(CASE WHEN {0} < 1e-5 THEN 1 ELSE {0} END)".format
E12_ONE = f"(-(vi - gi) * log2({_one('vi')}) - (vj - gj) * log2({_one('vj')}) + (vij - gij) * log2({_one('vij')}) + (vi + vj - vij - gi - gj + gij) * log2(total)) / total"
COUNTS = "(SELECT *, ci_g AS gi, cj_g AS gj, ci_g + cj_g - 2 * mc AS gij FROM pr)"
WEIGHTS = "(SELECT *, wi_g AS gi, wj_g AS gj, wi_g + wj_g - 2 * mw AS gij FROM pr)"

# ---------------------------------------------------------------- degrees, entropy, gains

for prefix, graph, sql in (("", trade, T), ("shp_", shp, S)):
    name = prefix + "{}"
    # Sums of weights of nine digits: at six, every thousandth would stand between two values.
    r = 6 if graph is trade else 4
    _query(name.format("degree"), sql + f"SELECT node, round(degree, {r}) + 0.0 AS degree FROM deg")(lambda s, d, g=graph, r=r: rounded(entropy.degree(g(s, d)[0]), r))
    _query(name.format("volume"), sql + f"SELECT round(sum(degree), {r}) AS volume FROM deg")(lambda s, d, g=graph, r=r: rounded(entropy.volume(g(s, d)[0]), r))
    _query(name.format("node_edge_counts"), sql + "SELECT count(*) AS n_nodes, CAST(sum(k) / 2 AS BIGINT) AS n_edges, round(sum(k) / count(*), 6) AS avg_degree FROM deg")(lambda s, d, g=graph: rounded(entropy.sizes(g(s, d)[0])))
    _query(name.format("entropy_1d"), sql + "SELECT round(log2(sum(degree)) - sum(degree * log2(degree)) / sum(degree), 6) AS h1 FROM deg")(lambda s, d, g=graph: rounded(entropy.entropy_1d(g(s, d)[0])))
    _query(name.format("entropy_1d_unweighted"), sql + "SELECT round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS h1 FROM deg")(lambda s, d, g=graph: rounded(entropy.entropy_1d(g(s, d)[0], False)))
    _query(name.format("entropy_2d"), sql + H2)(lambda s, d, g=graph: rounded(entropy.entropy_2d(*g(s, d))))
    _query(name.format("entropy_1d_partition"), sql + "SELECT round(log2(sum(degree)) - sum(degree * log2(degree)) / sum(degree), 6) AS h1 FROM deg")(lambda s, d, g=graph: rounded(entropy.entropy_1d_partition(*g(s, d))))
    _query(name.format("part_stats"), sql + f"SELECT cid, round(vol, {r}) AS vol, cut_count, round(cut_weight, {r}) AS cut_weight FROM stats")(lambda s, d, g=graph, r=r: rounded(entropy.part_stats(*g(s, d)), r))
    _query(name.format("cut_size"), sql + f"SELECT cid, round(cut_weight, {r}) AS cut_size FROM stats")(lambda s, d, g=graph, r=r: rounded(entropy.cut_size(*g(s, d)), r))
    _query(name.format("part_di"), sql + "SELECT cid, round(CASE WHEN vol / total < 1e-5 THEN 0 ELSE -((vol - cut_count) / total) * log2(vol / total) END, 6) + 0.0 AS di FROM stats, tot")(lambda s, d, g=graph: rounded(entropy.part_di(*g(s, d))))
    _query(name.format("total_di"), sql + "SELECT round(sum(CASE WHEN vol / total < 1e-5 THEN 0 ELSE -((vol - cut_count) / total) * log2(vol / total) END), 3) AS di FROM stats, tot")(lambda s, d, g=graph: entropy.total_di(*g(s, d)))
    _query(name.format("di_rate"), sql + f"SELECT round((a.h1x - a.h2x) / a.h1x, 6) AS di_rate FROM (SELECT log2(total) - dv / total AS h1x, (pv - dv - gv + g * log2(total)) / total AS h2x {H2[H2.index('FROM'):]}) a")(lambda s, d, g=graph: rounded(entropy.di_rate(*g(s, d))))
    _query(name.format("pair_stats"), sql + f"SELECT ci, cj, round(vi, {r}) AS vi, round(vj, {r}) AS vj, round(vij, {r}) AS vij, ci_g AS gi, cj_g AS gj, ci_g + cj_g - 2 * mc AS gij FROM pr WHERE mc > 0")(lambda s, d, g=graph, r=r: rounded(entropy.pair_stats(*g(s, d)), r))
    _query(name.format("pair_delta_di_adjacent"), sql + f"SELECT ci, cj, round({E12}, 6) + 0.0 AS delta FROM {COUNTS} WHERE mc > 0 AND vi >= 1e-5 AND vj >= 1e-5" if graph is trade else sql + f"SELECT ci, cj, round({E12_ONE}, 6) + 0.0 AS delta FROM {COUNTS} WHERE mc > 0")(lambda s, d, g=graph: rounded(entropy.pair_gains(*g(s, d), adjacent_only=True)))

_query("entropy_1d_terms", T + "SELECT node, round(CASE WHEN degree / total < 1e-10 THEN 0 ELSE -(degree / total) * log2(degree / total) END, 6) + 0.0 AS term FROM deg, tot")(lambda s, d: rounded(entropy.entropy_1d_terms(trade(s, d)[0])))
_query("pair_delta_di", T + f"SELECT ci, cj, round({E12}, 6) + 0.0 AS delta FROM {COUNTS}")(lambda s, d: rounded(entropy.pair_gains(*trade(s, d))))
_query("pair_delta_entropy", T + f"SELECT ci, cj, round(((vi - gi) * log2(vi) + (vj - gj) * log2(vj) - (vij - gij) * log2(vij) + (gi + gj - gij) * log2(total + 1e-10)) / total, 6) + 0.0 AS delta FROM {WEIGHTS}")(lambda s, d: rounded(entropy.pair_gains(*trade(s, d), "entropy")))
RP = "(-({v} - {g}) / (total + 1e-10) * log2({v} / (total + 1e-10) + 1e-10))"
_query("pair_delta_rate", T + f"SELECT ci, cj, round({RP.format(v='vi', g='gi')} + {RP.format(v='vj', g='gj')} - {RP.format(v='vij', g='gij')}, 6) + 0.0 AS delta FROM {WEIGHTS}")(lambda s, d: rounded(entropy.pair_gains(*trade(s, d), "rate")))
_query("best_merge", T + f"SELECT ci, cj, round({E12}, 6) + 0.0 AS delta FROM {COUNTS} ORDER BY {E12}, ci, cj LIMIT 1")(lambda s, d: rounded(entropy.pair_gains(*trade(s, d)).orderBy("delta", "ci", "cj").limit(1)))
_query("merge_exists", T + f"SELECT count(*) > 0 AS merge_exists FROM {COUNTS} WHERE {E12} < 0")(lambda s, d: entropy.pair_gains(*trade(s, d)).where("delta < 0").limit(1).agg((F.count("*") > 0).alias("merge_exists")))
EDGE = """SELECT e.u, e.v, round((-(a.degree - a.k) * log2(a.degree) - (b.degree - b.k) * log2(b.degree) + (a.degree + b.degree - (a.k + b.k - 2)) * log2(a.degree + b.degree) + (0 - a.k - b.k + (a.k + b.k - 2)) * log2(total)) / total, 3) + 0.0 AS delta
FROM trade e JOIN deg a ON e.u = a.node JOIN deg b ON e.v = b.node, tot"""
_query("edge_delta_di", T + EDGE)(lambda s, d: rounded(entropy.edge_gains(trade(s, d)[0]), 3))
_query("codelength", T + """SELECT round(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END - 2 * lq - ln + lqp, 6) AS codelength FROM (SELECT sum(cut_weight / total) AS q, sum(CASE WHEN cut_weight > 0 THEN cut_weight / total * log2(cut_weight / total) ELSE 0 END) AS lq,
  sum((cut_weight + vol) / total * log2((cut_weight + vol) / total)) AS lqp FROM stats, tot), (SELECT sum(degree * log2(degree)) / sum(degree) - log2(sum(degree)) AS ln FROM deg)""")(lambda s, d: rounded(priors.codelength(*trade(s, d))))

# ---------------------------------------------------------------- graphs of vectors

P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), pairs AS (SELECT a.id AS u, b.id AS v, a.x AS p, b.x AS q, list_zip(a.x, b.x) AS z FROM p a JOIN p b ON a.id < b.id)"
_t = "list_transform(z, lambda t: {})"
DOT = "list_sum(" + _t.format("t[1] * t[2]") + ")"
CENTER = "list_zip(list_transform(p, lambda e: e - list_avg(p)), list_transform(q, lambda e: e - list_avg(q)))"
EUCLID = "sqrt(list_sum(" + _t.format("(t[1] - t[2]) * (t[1] - t[2])") + "))"
METRIC_SQL = {
    "euclidean": EUCLID,
    "manhattan": "list_sum(" + _t.format("abs(t[1] - t[2])") + ")",
    "minkowski3": "cbrt(list_sum(" + _t.format("pow(abs(t[1] - t[2]), 3)") + "))",
    "chebyshev": "list_max(" + _t.format("abs(t[1] - t[2])") + ")",
    "canberra": "list_sum(" + _t.format("CASE WHEN abs(t[1]) + abs(t[2]) > 0 THEN abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2])) ELSE 0 END") + ")",
    "braycurtis": "list_sum(" + _t.format("abs(t[1] - t[2])") + ") / list_sum(" + _t.format("abs(t[1] + t[2])") + ")",
    "mahalanobis_pair": "list_sum(" + _t.format("(t[1] - t[2]) * (t[1] - t[2])") + ") / sqrt(2)",
    "cosine": f"1 - {DOT} / (sqrt(list_sum(list_transform(p, lambda e: e * e))) * sqrt(list_sum(list_transform(q, lambda e: e * e))))",
    "rbf": "greatest(0.01, exp(-list_sum(" + _t.format("(t[1] - t[2]) * (t[1] - t[2])") + ")))",
}
R = "(list_sum(list_transform(c, lambda t: t[1] * t[2])) / (sqrt(list_sum(list_transform(c, lambda t: t[1] * t[1]))) * sqrt(list_sum(list_transform(c, lambda t: t[2] * t[2])))))"
#: Least weights of the graphs' edges.
LEAST = {"euclidean": 1 / 1.2, "manhattan": 1 / 7.6, "minkowski3": 1 / 0.66, "chebyshev": 1 / 0.34, "canberra": 1 / 37.0, "braycurtis": 1 / 0.95, "mahalanobis_pair": 1 / 1.0, "correlation": 1.25, "cosine": 1.25, "pearson_r": 0.3, "rbf": 7.0}


def _values(metric: str) -> str:
    if metric in ("correlation", "pearson_r"):
        return f"WITH {P}, vals AS (SELECT u, v, {'1 - ' if metric == 'correlation' else ''}{R} AS d FROM (SELECT u, v, {CENTER} AS c FROM pairs))"
    return f"WITH {P}, vals AS (SELECT u, v, {METRIC_SQL[metric]} AS d FROM pairs)"


for metric, least in LEAST.items():
    weight = "d" if metric in ("correlation", "cosine", "pearson_r") else "CASE WHEN d <= 1e-5 THEN (SELECT max(d) FROM vals) ELSE 1 / d END"
    _query(f"graph_{metric}", _values(metric) + f" SELECT u, v, round(w, 6) AS w FROM (SELECT u, v, {weight} AS w FROM vals) WHERE w >= {least}")(lambda s, d, m=metric, k=least: rounded(graphs.metric_graph(vectors(s, d), m, k)))
    _query(f"dist_{metric}", _values(metric) + """, r AS (SELECT min(d) AS lo, (max(d) - min(d)) / 100 AS width, count(*) AS total FROM vals)
SELECT bin, round(lo + bin * width, 6) + 0.0 AS low, n, round(n / (total * width), 6) AS density FROM (SELECT CAST(least(99, greatest(0, floor((d - lo) / width))) AS INT) AS bin, count(*) AS n FROM vals, r GROUP BY 1), r""")(lambda s, d, m=metric: rounded(graphs.histogram(vectors(s, d), m)))
_query("graph_minkowski4", f"WITH {P}, vals AS (SELECT u, v, pow(list_sum({_t.format('pow(t[1] - t[2], 4)')}), 0.25) AS d FROM pairs) SELECT u, v, round(1 / d, 6) AS w FROM vals WHERE d > 1e-5 AND 1 / d >= 2.0")(
    lambda s, d: rounded(graphs.metric_graph(vectors(s, d), metrics.minkowski(4), 2.0))
)
_query("graph_pearson")(lambda s, d: rounded(graphs.metric_graph(vectors(s, d), "pearson", 0.99)))
_query("dist_fitted", _values("euclidean") + """, r AS (SELECT min(d) AS lo, (max(d) - min(d)) / 1000 AS width FROM vals),
h AS (SELECT lo + bin * width + width / 2 AS mid, n FROM (SELECT CAST(least(999, greatest(0, floor((d - lo) / width))) AS INT) AS bin, count(*) AS n FROM vals, r GROUP BY 1), r),
m AS (SELECT sum(n * mid) / sum(n) AS mean, (SELECT min(mid) FROM (SELECT mid, sum(n) OVER (ORDER BY mid) AS upto, sum(n) OVER () AS every FROM h) WHERE upto * 2 >= every) AS median FROM h),
s AS (SELECT mean, median, sqrt(sum(n * pow(mid - mean, 2)) / sum(n)) AS sd, sum(n * abs(mid - median)) / sum(n) AS mad FROM h, m GROUP BY 1, 2)
SELECT 'norm' AS family, round(mean, 6) AS location, round(sd, 6) AS scale FROM s UNION ALL SELECT 'laplace', round(median, 6), round(mad, 6) FROM s""")(lambda s, d: rounded(graphs.fitted(vectors(s, d), "euclidean")))

_query("dist_fitted_t")(lambda s, d: rounded(graphs.fitted_t(vectors(s, d), "euclidean")))

E_SQL = _values("euclidean")
KNN = E_SQL + ", both_ AS (SELECT u AS id, v AS other, d FROM vals UNION ALL SELECT v, u, d FROM vals), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM both_)"
_query("nearest", KNN + " SELECT id, other, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")(lambda s, d: rounded(graphs.nearest(vectors(s, d), 5)))
SYM = KNN + ", knn AS (SELECT least(id, other) AS u, greatest(id, other) AS v, 1 / (sum(d) / 2 + 1e-5) AS w, max(d) AS d FROM ranked WHERE rank <= 10 GROUP BY 1, 2 HAVING sum(d) > 0)"
_query("graph_knn_sym", SYM + " SELECT u, v, round(w, 6) AS w, round(d, 6) AS d FROM knn")(lambda s, d: rounded(graphs.knn_graph(vectors(s, d), 10)))
_query("knn_pruned", SYM + """, inc AS (SELECT u AS node, u, v, d FROM knn UNION ALL SELECT v, u, v, d FROM knn), alone AS (SELECT DISTINCT u, v, d FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, u, v) AS rk, min(d) OVER (PARTITION BY node) AS lo FROM inc) WHERE rk = 1 AND lo > 1.2)
SELECT u, v, round(w, 6) AS w, round(d, 6) AS d FROM knn WHERE d <= 1.2 UNION ALL SELECT u, v, round(1 / (d + 1e-5), 6), round(d, 6) FROM alone""")(lambda s, d: rounded(graphs.prune(graphs.knn_graph(vectors(s, d), 10), 1.2)))
_query("graph_knn_distance", KNN + " SELECT least(id, other) AS u, greatest(id, other) AS v, round(max(1 / d), 6) AS w FROM ranked WHERE rank <= 4 AND 1 / d >= 0.8 GROUP BY 1, 2")(lambda s, d: rounded(graphs.knn_distance_graph(vectors(s, d), 5, 0.8)))
_query("graph_radius", E_SQL + " SELECT u, v, round(1 / (d + 1e-5), 6) AS w, round(d, 6) AS d FROM vals WHERE d <= 1.2 AND d > 0")(lambda s, d: rounded(graphs.radius_graph(vectors(s, d), 1.2)))
_query("graph_enn", E_SQL + " SELECT u, v, CAST(1 AS DOUBLE) AS w FROM vals WHERE d <= 1.2")(lambda s, d: graphs.epsilon_graph(vectors(s, d), 1.2))
_query("graph_rbf_kernel", E_SQL + " SELECT u, v, round(exp(-d * d / 64), 6) AS w, round(d, 6) AS d FROM vals WHERE exp(-d * d / 64) >= 0.978")(lambda s, d: rounded(graphs.rbf_graph(vectors(s, d), 0.978)))
NEAR = E_SQL + ", e AS (SELECT u, v, d FROM vals WHERE d <= 1.2 AND d > 0), linked AS (SELECT u AS id FROM e UNION SELECT v FROM e), alone AS (SELECT id FROM p WHERE id NOT IN (SELECT id FROM linked)), both_ AS (SELECT u AS id, v AS other, d FROM vals UNION ALL SELECT v, u, d FROM vals)"
_query("repair_isolated", NEAR + """ SELECT least(id, other) AS u, greatest(id, other) AS v, round(1 / (d + 1e-5), 6) AS w FROM (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY d, other) AS rk
FROM both_ b JOIN alone USING (id) WHERE other IN (SELECT id FROM linked) OR other < b.id) WHERE rk = 1""")(lambda s, d: rounded(graphs.repair(vectors(s, d), near_graph(s, d))))
_query("nearest_node", NEAR + " SELECT id, other, round(d, 6) AS d FROM (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY d, other) AS rk FROM both_ b JOIN alone USING (id) WHERE other IN (SELECT id FROM linked)) WHERE rk = 1")(
    lambda s, d: rounded(graphs.nearest_of(graphs.isolated(vectors(s, d), near_graph(s, d)), vectors(s, d).join(graphs.isolated(vectors(s, d), near_graph(s, d)).select("id"), "id", "left_anti")))
)
REACH = ", arcs AS (SELECT u AS a, v AS b FROM {e} UNION SELECT v, u FROM {e} UNION SELECT u, u FROM {e} UNION SELECT v, v FROM {e}), reach(node, root) AS (SELECT a, a FROM arcs UNION SELECT b, root FROM reach JOIN arcs ON node = a AND root < b), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_query("components", _recursive(NEAR) + REACH.format(e="e") + " SELECT node, component FROM comp")(lambda s, d: connected_components(near_graph(s, d)))
_query("shp_components", _recursive(f"WITH {G}") + REACH.format(e="shp") + " SELECT node, component FROM comp")(lambda s, d: connected_components(shp(s, d)[0]))
_query("bridge_one_round", _recursive(NEAR) + REACH.format(e="(SELECT u, v FROM e UNION ALL SELECT id, id FROM p)") + """, out_ AS (SELECT a.component AS c, least(b.id, b.other) AS u, greatest(b.id, b.other) AS v, d FROM both_ b JOIN comp a ON a.node = b.id JOIN comp o ON o.node = b.other WHERE a.component <> o.component)
SELECT DISTINCT u, v, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, u, v) AS rk FROM out_) WHERE rk = 1""")(lambda s, d: rounded(graphs.bridge_round(vectors(s, d), near_graph(s, d))))
#: Prim's algorithm over the components: one edge a step, the shortest that leaves what is joined.
PRIM = """, links AS (SELECT a.component AS c1, o.component AS c2, min(struct_pack(d := d, u := least(b.id, b.other), v := greatest(b.id, b.other))) AS e FROM both_ b JOIN comp a ON a.node = b.id JOIN comp o ON o.node = b.other WHERE a.component <> o.component GROUP BY 1, 2),
prim(step, seen, e) AS (SELECT 0, [min(component)], CAST(NULL AS STRUCT(d DOUBLE, u BIGINT, v BIGINT)) FROM comp
  UNION ALL SELECT step + 1, list_append(any_value(seen), arg_min(c2, l.e)), min(l.e) FROM prim JOIN links l ON list_contains(seen, c1) AND NOT list_contains(seen, c2) GROUP BY step)
SELECT e.u AS u, e.v AS v, round({w}, 6) + 0.0 AS w FROM prim WHERE e IS NOT NULL"""
_query("bridge_all", _recursive(NEAR) + REACH.format(e="(SELECT u, v FROM e UNION ALL SELECT id, id FROM p)") + PRIM.format(w="1 / (e.d + 1e-5)"))(lambda s, d: rounded(graphs.bridge(vectors(s, d), near_graph(s, d))))
CORE = E_SQL + ", near_ AS (SELECT u, v FROM vals WHERE d <= 1.22), both_ AS (SELECT u AS id, v AS o FROM near_ UNION ALL SELECT v, u FROM near_), core AS (SELECT id FROM both_ GROUP BY id HAVING count(*) + 1 >= 12)"
_query("dbscan_core", CORE + " SELECT id FROM core")(lambda s, d: graphs.radius_pairs(vectors(s, d), 1.22).select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n + 1 >= 12").select("id"))
DENSE = _recursive(CORE) + ", linked AS (SELECT u, v FROM near_ WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core) UNION ALL SELECT id, id FROM core)" + REACH.format(e="linked") + """, border AS (SELECT id, min(component) AS cluster FROM both_ JOIN comp ON o = node WHERE id NOT IN (SELECT id FROM core) GROUP BY id), got AS (SELECT node AS id, component AS cluster FROM comp UNION ALL SELECT * FROM border),
dense AS (SELECT p.id, cluster FROM p LEFT JOIN got USING (id))"""
_query("dbscan", DENSE + " SELECT id, cluster FROM dense")(lambda s, d: priors.dbscan(vectors(s, d), graphs.radius_pairs(vectors(s, d), 1.22), 12))
_query("dbscan_partition", DENSE + " SELECT id AS node, coalesce(cluster, -2 - id) AS cid FROM dense")(lambda s, d: priors.as_partition(priors.dbscan(vectors(s, d), graphs.radius_pairs(vectors(s, d), 1.22), 12)))
_STEP = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
PLACE_DENSE = f"""WITH RECURSIVE {PLACES_SQL}, p AS (SELECT id FROM places), near_ AS (SELECT a.id AS u, b.id AS v FROM places a JOIN places b ON a.id < b.id AND b.lat BETWEEN a.lat - 0.0006 AND a.lat + 0.0006 WHERE {_STEP} <= 60),
both_ AS (SELECT u AS id, v AS o FROM near_ UNION ALL SELECT v, u FROM near_), core AS (SELECT id FROM both_ GROUP BY id HAVING count(*) + 1 >= 5)""" + DENSE[len(_recursive(CORE)):]
_query("dbscan_places", PLACE_DENSE + " SELECT id, cluster FROM dense")(lambda s, d: priors.dbscan(places(table(s, d, "x_shp")), spatial.near_pairs(places(table(s, d, "x_shp")), 60.0).select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), 5))
_query("kmeans")(lambda s, d: priors.kmeans(vectors(s, d), 10))

# ---------------------------------------------------------------- graphs of places, by cells


def plane(spark: SparkSession, d: str) -> DataFrame:
    return places(table(spark, d, "x_shp")).select("id", F.array("lon", "lat").alias("x"))


def place_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.radius_graph(plane(spark, d), 0.3).select("u", "v", "w")


PLANE = f"WITH {PLACES_SQL}, p AS (SELECT id FROM places), both_ AS (SELECT a.id, b.id AS other, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) AS d FROM places a JOIN places b ON a.id <> b.id)"
PLACE_E = ", e AS (SELECT id AS u, other AS v, d FROM both_ WHERE id < other AND d <= 0.3 AND d > 0), linked AS (SELECT u AS id FROM e UNION SELECT v FROM e), alone AS (SELECT id FROM p WHERE id NOT IN (SELECT id FROM linked))"
_query("place_nearest", PLANE + " SELECT id, other, round(d, 9) AS d, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM both_) WHERE rank <= 5")(lambda s, d: rounded(graphs.nearest(plane(s, d), 5), 9))
_query("place_knn_graph", PLANE + """ SELECT least(id, other) AS u, greatest(id, other) AS v, round(1 / (sum(d) / 2 + 1e-5), 3) AS w, round(max(d), 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM both_)
WHERE rank <= 10 GROUP BY 1, 2 HAVING sum(d) > 0""")(lambda s, d: graphs.knn_graph(plane(s, d), 10).select("u", "v", F.round("w", 3).alias("w"), F.round("d", 9).alias("d")))
_query("place_radius", PLANE + PLACE_E + " SELECT u, v, round(1 / (d + 1e-5), 3) AS w, round(d, 9) AS d FROM e")(lambda s, d: graphs.radius_graph(plane(s, d), 0.3).select("u", "v", F.round("w", 3).alias("w"), F.round("d", 9).alias("d")))
_query("place_repair", PLANE + PLACE_E + """ SELECT least(id, other) AS u, greatest(id, other) AS v, round(1 / (d + 1e-5), 3) AS w FROM (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY d, other) AS rk FROM both_ b JOIN alone USING (id)
WHERE other IN (SELECT id FROM linked) OR other < b.id) WHERE rk = 1""")(lambda s, d: rounded(graphs.repair(plane(s, d), place_graph(s, d)), 3))
_RBF = "sqrt(greatest(0, ln(exp(-0.25 * d * d) + 1e-5) / -0.25)) / (d + 1e-5)"
_query("place_repair_rbf", PLANE + PLACE_E + f""" SELECT least(id, other) AS u, greatest(id, other) AS v, round({_RBF}, 6) AS w FROM (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY d, other) AS rk FROM both_ b JOIN alone USING (id)
WHERE other IN (SELECT id FROM linked) OR other < b.id) WHERE rk = 1""")(lambda s, d: rounded(graphs.repair(plane(s, d), place_graph(s, d), 0.25)))
_query("place_bridge", PLANE.replace("WITH ", "WITH RECURSIVE ", 1) + PLACE_E.replace("0.3", "1.5") + REACH.format(e="(SELECT u, v FROM e UNION ALL SELECT id, id FROM p)") + PRIM.format(w="1 / (e.d + 1e-5)"))(lambda s, d: rounded(graphs.bridge(plane(s, d), graphs.radius_links(plane(s, d), 1.5))))
_query("node_attributes", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name, CAST(NULL AS DOUBLE) AS x_0 FROM nation WHERE FALSE UNION ALL SELECT vec_id, 'label ' || label, CAST(embedding[1] AS DOUBLE) FROM embeddings")(
    lambda s, d: graphs.with_attributes(vector_labels(s, d).select("id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("n_name")), vectors(s, d).select("id", F.slice("x", 1, 1).alias("x")))
)

# ---------------------------------------------------------------- partitions and quality

_query("labels", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INT) AS label FROM (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS head FROM nation)")(lambda s, d: partition.labels(trade(s, d)[1].select(F.col("node").alias("id")), trade(s, d)[1]))
_query("partition_lists", "SELECT CAST(n_regionkey AS BIGINT) AS cid, list_sort(list(CAST(n_nationkey AS BIGINT))) AS nodes FROM nation GROUP BY 1")(lambda s, d: partition.as_lists(trade(s, d)[1]))
_query("greedy_steps")(lambda s, d: partition.greedy_steps(trade(s, d)[0], steps=100)[0])
_query("greedy_trace")(lambda s, d: partition.greedy_steps(trade(s, d)[0], steps=100)[1])
_query("greedy_di")(lambda s, d: partition.greedy(trade(s, d)[0], "di"))
_query("greedy_rate")(lambda s, d: partition.greedy(trade(s, d)[0], "rate"))
_query("greedy_entropy")(lambda s, d: partition.greedy(trade(s, d)[0], "entropy"))


def _fixture(s: SparkSession) -> DataFrame:
    """A graph of 14 nodes in three groups, whose best partition and its steps are known."""
    pairs = "0-1 0-2 0-3 1-2 1-3 2-3 2-4 4-5 4-7 5-6 5-7 5-8 6-8 7-8 8-9 9-10 9-12 9-13 10-11 10-12 11-12 11-13 12-13".split()
    return s.createDataFrame([(*map(int, p.split("-")), 1.0) for p in pairs], "u bigint, v bigint, w double")


_PARTS14 = "SELECT CAST(range AS BIGINT) AS node, CAST(CASE WHEN range < 4 THEN 0 WHEN range < 9 THEN 1 ELSE 2 END AS BIGINT) AS cid FROM range(14)"
_query("known_trace", "SELECT CAST(k - 1 AS INT) AS iter, CAST(di[least(k, 13)] AS DOUBLE) AS di FROM (SELECT unnest(range(1, 18)) AS k, [0.0, .128, .287, .476, .603, .763, .891, 1.009, 1.136, 1.296, 1.296, 1.345, 1.439] AS di)")(lambda s, d: partition.greedy_steps(_fixture(s), steps=16)[1])
_query("known_steps", _PARTS14)(lambda s, d: partition.greedy_steps(_fixture(s), steps=20)[0])
_query("known_di", _PARTS14)(lambda s, d: partition.greedy(_fixture(s), "di"))
_query("known_cliques", "SELECT CAST(range AS BIGINT) AS node, CAST(range // 5 AS BIGINT) AS cid FROM range(30)")(lambda s, d: partition.greedy_steps(dynamics.ring_of_cliques(s), steps=60)[0])
_query("known_cliques_flow", "SELECT CAST(range AS BIGINT) AS id, CAST(range // 5 AS INT) AS label FROM range(30)")(lambda s, d: partition.labels(s.range(30), priors.flow_partition(dynamics.ring_of_cliques(s))))
_GRID = ((0, 1, 2, 3), (4, 8, 9, 13, 14, 19), (5, 6, 7, 10), (11, 12, 16, 17), (15, 20, 25), (18, 23, 24, 28, 29), (21, 22, 26, 27))
_query("known_grid", "SELECT CAST(node AS BIGINT) AS node, CAST(cid AS BIGINT) AS cid FROM (VALUES " + ", ".join(f"({n}, {k})" for k, p in enumerate(_GRID) for n in p) + ") t(node, cid)")(lambda s, d: partition.greedy_steps(dynamics.grid_graph(s), steps=100)[0])
_query("merge_rounds")(lambda s, d: partition.merge_rounds(trade(s, d)[0]))
_query("shp_merge_rounds")(lambda s, d: partition.merge_rounds(shp(s, d)[0], gain="rate"))
_query("flow_partition")(lambda s, d: priors.flow_partition(near_graph(s, d)))
_query("silhouette", E_SQL + """, both_ AS (SELECT u AS id, v AS other, d FROM vals UNION ALL SELECT v, u, d FROM vals), m AS (SELECT b.id, a.label AS mine, o.label, sum(d) AS total, count(*) AS n FROM both_ b JOIN p a ON a.id = b.id JOIN p o ON o.id = b.other GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN mine = label THEN total / n END) AS a, min(CASE WHEN mine <> label THEN total / n END) AS b FROM m GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette, count(*) AS n FROM s WHERE b IS NOT NULL""")(lambda s, d: rounded(quality.silhouette(vectors(s, d), vector_labels(s, d))))
_query("calinski_harabasz", """WITH l AS (SELECT vec_id, label, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), c AS (SELECT label, k, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1, 2),
g AS (SELECT k, avg(v) AS g FROM l GROUP BY k), t AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * s) AS w, count(DISTINCT label) AS c FROM c JOIN g USING (k)) SELECT round((b / (c - 1)) / (w / ((SELECT count(*) FROM embeddings) - c)), 6) AS calinski_harabasz FROM t""")(lambda s, d: rounded(quality.calinski_harabasz(vectors(s, d), vector_labels(s, d))))
_query("outlines")(lambda s, d: quality.outlines(places(table(s, d, "x_shp")).select("id", F.array("lon", "lat").alias("x")), places(table(s, d, "x_shp")).select(F.col("id").alias("node"), F.floor("lat").cast("bigint").alias("cid"))).select("cid", "num", F.size("hull").alias("corners")))
_query("alpha_outlines", f"""WITH {PLACES_SQL}, p AS (SELECT id, lon AS x, lat AS y, CAST(floor(lat) AS BIGINT) AS cid FROM places), q AS (SELECT cid, x, y, min(id) AS id FROM p GROUP BY ALL),
e AS (SELECT a.cid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.id AS u, b.id AS v, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS dd FROM q a JOIN q b ON a.cid = b.cid AND a.id < b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.36),
c AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt(greatest(0, 0.09 / dd - 0.25)) AS h FROM e),
k AS (SELECT cid, u, v, max(CASE WHEN pow(q.x - (mx - (y2 - y1) * h), 2) + pow(q.y - (my + (x2 - x1) * h), 2) < 0.09 - 1e-9 THEN 1 ELSE 0 END) AS l, max(CASE WHEN pow(q.x - (mx + (y2 - y1) * h), 2) + pow(q.y - (my - (x2 - x1) * h), 2) < 0.09 - 1e-9 THEN 1 ELSE 0 END) AS r
  FROM c JOIN q USING (cid) WHERE q.id <> u AND q.id <> v GROUP BY ALL UNION ALL SELECT cid, u, v, 0, 0 FROM c)
SELECT cid, u, v FROM k GROUP BY ALL HAVING max(l) = 0 OR max(r) = 0""")(lambda s, d: quality.alpha_outlines(plane(s, d), plane(s, d).select(F.col("id").alias("node"), F.floor(F.get("x", 1)).cast("bigint").alias("cid")), 0.3).select("cid", "u", "v"))
_query("fit")(lambda s, d: estimator.InformationClustering(affinity="radius", radius=1.2, prior="flow").fit(vectors(s, d)).summary())

# ---------------------------------------------------------------- projections and shapes

_query("standardize", """WITH l AS (SELECT vec_id AS id, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY k)
SELECT id, CAST(k - 1 AS INT) AS k, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS v FROM l JOIN s USING (k)""")(lambda s, d: rounded(estimator.standardize(vectors(s, d)).select("id", F.posexplode("x").alias("k", "v"))))
_query("pca")(lambda s, d: estimator.reduce_dimensions(vectors(s, d), 2))
_query("point_in_polygon", f"""WITH {PLACES_SQL}, v AS (SELECT DISTINCT * FROM ring WHERE x IS NOT NULL AND y IS NOT NULL),
sides AS (SELECT ring_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring_id, part_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT ring_id, id FROM places JOIN sides ON y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) GROUP BY ring_id, id HAVING count(*) % 2 = 1""")(lambda s, d: spatial.regions_of(places(table(s, d, "x_shp")), table(s, d, "ring")))


@_query("web_mercator", f"WITH {PLACES_SQL} SELECT id, round(radians(lon) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM places")
def _mercator(s: SparkSession, d: str) -> DataFrame:
    x, y = projection.to_mercator(F.col("lon"), F.col("lat"))
    return rounded(places(table(s, d, "x_shp")).select("id", x.alias("x"), y.alias("y")), 3)


def _krueger() -> str:
    """The series in SQL, written out from the constants of the ellipsoid."""
    f = 1 / 298.3
    n = f / (2 - f)
    big, e = 6378245.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    x = "eta + " + " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(terms, 1))
    y = "xi + " + " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(terms, 1))
    return f"""WITH {PLACES_SQL}, t AS (SELECT id, radians(lon - 117.0) AS lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t FROM places),
z AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t) SELECT id, round({big!r} * ({x}) + 500000.0, 2) + 0.0 AS x, round({big!r} * ({y}), 2) + 0.0 AS y FROM z"""


@_query("transverse_mercator", _krueger())
def _transverse(s: SparkSession, d: str) -> DataFrame:
    x, y = projection.to_transverse_mercator(F.col("lon"), F.col("lat"))
    return rounded(places(table(s, d, "x_shp")).select("id", x.alias("x"), y.alias("y")), 2)


@_query("geometry_to_matrix", "SELECT try_cast(trim(id) AS bigint) AS id, round(degrees(geometry.x / 6378137.0), 7) + 0.0 AS lon, round(degrees(2 * atan(exp(geometry.y / 6378137.0)) - pi() / 2), 7) + 0.0 AS lat FROM x_shp WHERE srid = 3857 AND geometry.x IS NOT NULL AND abs(geometry.x) < 2.1e7 AND abs(geometry.y) < 2.1e7")
def _matrix_of(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "x_shp").where("srid = 3857 AND geometry.x IS NOT NULL AND abs(geometry.x) < 2.1e7 AND abs(geometry.y) < 2.1e7")
    lon, lat = projection.from_mercator(F.col("geometry.x"), F.col("geometry.y"))
    return rounded(x.select(whole_number(F.col("id")).alias("id"), lon.alias("lon"), lat.alias("lat")), 7)


@_query("edge_segments", f"WITH {G}, {PLACES_SQL} SELECT u, v, round(a.lon, 7) AS x1, round(a.lat, 7) AS y1, round(b.lon, 7) AS x2, round(b.lat, 7) AS y2, round(w, 4) AS weight FROM shp JOIN places a ON u = a.id JOIN places b ON v = b.id")
def _segments(s: SparkSession, d: str) -> DataFrame:
    p = places(table(s, d, "x_shp")).select("id", F.array("lon", "lat").alias("x"))
    e = shapefile.segments(shp(s, d)[0], p)
    return e.select("u", "v", *[(F.round(c, 4 if c == "weight" else 7) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2", "weight")])


ROADS = "WITH r AS (SELECT CAST(row_number() OVER () AS BIGINT) AS way_row, _id AS way, list_filter(list_transform(nd, lambda n: n._ref), lambda x: x IS NOT NULL) AS r FROM osm_way), seg AS (SELECT way, unnest(range(1, len(r))) AS i, r FROM r WHERE len(r) > 1), s AS (SELECT way, CAST(i - 1 AS BIGINT) AS pos, r[i] AS a, r[i + 1] AS b FROM seg), roads AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM s WHERE a <> b)"
_query("way_segments", ROADS + " SELECT way, pos, a, b FROM s")(lambda s, d: osm.way_segments(table(s, d, "osm_way")))
_query("road_graph", ROADS + " SELECT u, v, CAST(1 AS DOUBLE) AS w FROM roads")(roads)
_query("road_degree", ROADS + " SELECT node, CAST(count(*) AS DOUBLE) AS degree FROM (SELECT u AS node FROM roads UNION ALL SELECT v FROM roads) GROUP BY node")(lambda s, d: entropy.degree(roads(s, d)))
_SIMPLE = _recursive(ROADS) + """, arc AS (SELECT u, v FROM roads UNION ALL SELECT v, u FROM roads), inner_ AS (SELECT u AS id FROM arc GROUP BY u HAVING count(*) = 2),
tag AS (SELECT u, v, u IN (SELECT id FROM inner_) AS iu, v IN (SELECT id FROM inner_) AS iv FROM roads), chain AS (SELECT u, v FROM tag WHERE iu AND iv UNION ALL SELECT id, id FROM inner_)""" + REACH.format(e="chain") + """,
side AS (SELECT CASE WHEN iu THEN v ELSE u END AS tip, CASE WHEN iu THEN u ELSE v END AS node FROM tag WHERE iu <> iv),
tips AS (SELECT component, min(tip) AS u, max(tip) AS v FROM side JOIN comp USING (node) GROUP BY component), sizes AS (SELECT component, count(*) AS c FROM comp GROUP BY component)
SELECT u, v, CAST(1 AS BIGINT) AS n FROM tag WHERE NOT iu AND NOT iv UNION SELECT u, v, c + 1 FROM tips JOIN sizes USING (component) WHERE u <> v"""
_query("road_simplified", _SIMPLE)(lambda s, d: osm.simplify(roads(s, d)))
_query("road_relabelled", ROADS + ", m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS label FROM (SELECT u AS node FROM roads UNION SELECT v FROM roads)) SELECT CAST(least(a.label, b.label) AS BIGINT) AS u, CAST(greatest(a.label, b.label) AS BIGINT) AS v, CAST(1 AS DOUBLE) AS w FROM roads JOIN m a ON u = a.node JOIN m b ON v = b.node")(lambda s, d: osm.relabel(roads(s, d), roads(s, d).select(F.explode(F.array("u", "v")).alias("node")).select("node", F.col("node").alias("first")))[0])


def _ring_sides(s: SparkSession, d: str) -> DataFrame:
    """(line, a, b): the sides of all parts of the rings, from vertex to vertex (numbered by seq), in no order."""
    v = table(s, d, "ring").where("x IS NOT NULL AND y IS NOT NULL").select((F.col("ring_id") * 1000 + F.col("part_no")).alias("line"), "seq").distinct()
    w = W.partitionBy("line").orderBy("seq")
    e = v.select("line", F.col("seq").cast("bigint").alias("a"), F.lead("seq").over(w).cast("bigint").alias("b"), F.min("seq").over(W.partitionBy("line")).cast("bigint").alias("first"))
    return e.select("line", "a", F.coalesce("b", "first").alias("b")).where("a <> b")


_query("ring_order", "WITH v AS (SELECT DISTINCT ring_id * 1000 + part_no AS line, seq FROM ring WHERE x IS NOT NULL AND y IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM v) SELECT CAST(line AS BIGINT) AS line, CAST(row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS BIGINT) AS ord, CAST(seq AS BIGINT) AS node FROM n WHERE n > 1")(
    lambda s, d: osm.ring_lines(_ring_sides(s, d))
)
_query("edge_list_text", f"WITH {G} SELECT 0 AS ord, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS v, CAST(count(DISTINCT n) AS VARCHAR) AS line FROM (SELECT u AS n FROM trade UNION ALL SELECT v FROM trade) UNION ALL SELECT 1, u, v, u || ' ' || v || ' ' || CAST(CAST(w AS DOUBLE) AS VARCHAR) FROM trade")(lambda s, d: shapefile.edge_lines(trade(s, d)[0]).select("ord", "u", "v", "line"))
_query("gexf_text", f"""WITH {G} SELECT * FROM (VALUES (0, '<gexf version="1.2"><graph defaultedgetype="undirected"><nodes>'), (2, '</nodes><edges>'), (4, '</edges></graph></gexf>')) t(ord, line)
UNION ALL SELECT DISTINCT 1, '<node id="' || n || '"/>' FROM (SELECT u AS n FROM trade UNION ALL SELECT v FROM trade) UNION ALL SELECT 3, '<edge source="' || u || '" target="' || v || '" weight="' || CAST(CAST(w AS DOUBLE) AS VARCHAR) || '"/>' FROM trade""")(lambda s, d: shapefile.gexf_lines(trade(s, d)[0]))

# ---------------------------------------------------------------- series, reconstruction, distances between graphs

TS = """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events), days AS (SELECT min(day) AS first, date_diff('day', min(day), max(day)) AS n FROM e), sums AS (SELECT user_id AS id, day, sum(value) AS s FROM e GROUP BY 1, 2),
grid AS (SELECT id, first + CAST(k AS INTEGER) AS day FROM (SELECT DISTINCT id FROM sums), (SELECT first, unnest(range(0, n + 1)) AS k FROM days)), x AS (SELECT g.id, g.day, coalesce(s, 0.0) AS v FROM grid g LEFT JOIN sums USING (id, day)),
c AS (SELECT a.id AS u, b.id AS v, corr(a.v, b.v) AS w FROM x a JOIN x b ON a.day = b.day AND a.id < b.id GROUP BY 1, 2)"""
_query("recon_correlation", TS + " SELECT u, v, round(w, 6) + 0.0 AS w FROM c WHERE w >= 0.3")(lambda s, d: rounded(dynamics.correlations(user_series(s, d)).where("w >= 0.3")))
_query("degree_threshold", TS + " SELECT u, v, round(w, 6) + 0.0 AS w FROM c WHERE w IS NOT NULL ORDER BY abs(w) DESC, u, v LIMIT 200")(lambda s, d: rounded(dynamics.correlated_by_degree(user_series(s, d), 4)))
# The SQL of degree_threshold says 200 pairs, whatever the number of users; here it follows from them.
_query("degree_threshold_users", TS + " SELECT u, v, round(w, 6) + 0.0 AS w FROM (SELECT *, row_number() OVER (ORDER BY abs(w) DESC, u, v) AS rk FROM c WHERE w IS NOT NULL) WHERE rk <= round((SELECT count(DISTINCT id) FROM x) * 6 / 2.0)")(
    lambda s, d: rounded(dynamics.correlated_by_degree(user_series(s, d), 6))
)
MI = TS[: TS.index("c AS (SELECT a.id")] + """r AS (SELECT id, min(v) AS lo, max(v) AS hi FROM x GROUP BY id), b AS (SELECT id, day, CAST(least(3, greatest(0, floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 4 ELSE 1 END))) AS INT) AS k FROM x JOIN r USING (id)),
n AS (SELECT count(DISTINCT day) AS n FROM x), h AS (SELECT id, sum(c / n * log2(c / n)) AS h FROM (SELECT id, k, count(*) AS c FROM b GROUP BY 1, 2), n GROUP BY id),
j AS (SELECT u, v, sum(c / n * log2(c / n)) AS h FROM (SELECT p.id AS u, q.id AS v, p.k, q.k AS l, count(*) AS c FROM b p JOIN b q ON p.day = q.day AND p.id < q.id GROUP BY 1, 2, 3, 4), n GROUP BY u, v)"""
_query("recon_mutual_information", MI + " SELECT u, v, round(w, 6) + 0.0 AS w FROM (SELECT j.u, j.v, j.h - p.h - q.h AS w FROM j JOIN h p ON j.u = p.id JOIN h q ON j.v = q.id) WHERE w >= 0.3")(lambda s, d: rounded(dynamics.mutual_information(user_series(s, d)).where("w >= 0.3")))
_query("recon_partial_correlation")(lambda s, d: rounded(dynamics.partial_correlations(user_series(s, d)).where("abs(w) >= 0.1")))


def _simulated(s: SparkSession, model: str) -> DataFrame:
    g = [dynamics.ring_of_cliques(s), dynamics.grid_graph(s), dynamics.preferential_graph(s)]
    e = g[0].withColumn("graph", F.lit(0).cast("bigint"))
    for k in (1, 2):
        e = e.unionByName(g[k].withColumn("graph", F.lit(k).cast("bigint")))
    return dynamics.simulate(e, model)


for model in ("branching", "ising", "spin_glass"):
    _query(f"dynamics_{model}")(lambda s, d, m=model: _simulated(s, m).select("graph", "node", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total")))
_query("recon_ising")(lambda s, d: rounded(dynamics.by_degree(dynamics.ising_likelihood(_simulated(s, "ising").where("graph = 0").select(F.col("node").alias("id"), "x")), 30, 4.4)))
ARCS = "SELECT u AS a, v AS b FROM edge_shp WHERE u IS NOT NULL AND v IS NOT NULL"
_query("reciprocal_edges", f"WITH arcs AS ({ARCS}) SELECT DISTINCT x.a AS u, x.b AS v FROM arcs x JOIN arcs y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")(lambda s, d: dynamics.reciprocal(table(s, d, "edge_shp").where("u IS NOT NULL AND v IS NOT NULL")))
_query("hamming_distance", SYM + ", e AS (SELECT u, v FROM vals WHERE d <= 1.2) SELECT round((SELECT count(*) FROM (SELECT e.u AS a, k.u AS b FROM e FULL JOIN knn k ON e.u = k.u AND e.v = k.v) WHERE a IS NULL OR b IS NULL) / ((SELECT count(*) FROM p) * ((SELECT count(*) FROM p) - 1) / 2), 6) AS hamming")(
    lambda s, d: rounded(dynamics.hamming(near_graph(s, d), graphs.knn_graph(vectors(s, d), 10), vectors(s, d).count()))
)
_query("spectral_distance")(lambda s, d: rounded(dynamics.spectral_distance(dynamics.ring_of_cliques(s), dynamics.grid_graph(s), 30)))
_query("generator_cliques", "WITH n AS (SELECT range AS c FROM range(6)), m AS (SELECT range AS a FROM range(5)) SELECT CAST(c * 5 + x.a AS BIGINT) AS u, CAST(c * 5 + y.a AS BIGINT) AS v, CAST(1 AS DOUBLE) AS w FROM n, m x, m y WHERE x.a < y.a UNION ALL SELECT CAST(least(c * 5 + 1, (c + 1) % 6 * 5) AS BIGINT), CAST(greatest(c * 5 + 1, (c + 1) % 6 * 5) AS BIGINT), 1.0 FROM n")(lambda s, d: dynamics.ring_of_cliques(s))
_query("generator_grid", "WITH n AS (SELECT range AS i FROM range(30)) SELECT CAST(i AS BIGINT) AS u, CAST(i + 1 AS BIGINT) AS v, CAST(1 AS DOUBLE) AS w FROM n WHERE i % 5 < 4 UNION ALL SELECT CAST(i AS BIGINT), CAST(i + 5 AS BIGINT), 1.0 FROM n WHERE i < 25")(lambda s, d: dynamics.grid_graph(s))
_query("matrix_to_gray", f"WITH {G}, r AS (SELECT min(w) AS lo, max(w) AS hi FROM trade) SELECT u, v, CAST(floor(floor((w - lo) / (hi - lo) * 255) / 16) * 16 AS INT) AS gray FROM trade, r")(lambda s, d: dynamics.gray_levels(trade(s, d)[0], 16))
_query("gray_colors", f"WITH {G}, r AS (SELECT min(w) AS lo, max(w) AS hi FROM trade) SELECT *, CASE WHEN gray >= 160 THEN 'black' WHEN gray >= 64 THEN 'silver' ELSE 'white' END AS color FROM (SELECT u, v, CAST(floor(floor((w - lo) / (hi - lo) * 255) / 16) * 16 AS INT) AS gray FROM trade, r)")(lambda s, d: dynamics.gray_colors(dynamics.gray_levels(trade(s, d)[0], 16), {0: "white", 64: "silver", 160: "black"}))
_query("spectral_clusters")(lambda s, d: priors.spectral(near_graph(s, d), 6))
_query("compare_graphs")(lambda s, d: rounded(dynamics.compare_graphs(dynamics.ring_of_cliques(s), {"grid": dynamics.grid_graph(s)}, 30)))
GRAPHS = {"cliques": dynamics.ring_of_cliques, "grid": dynamics.grid_graph, "tree": dynamics.preferential_graph}
for graph_name, metric in [("cliques", m) for m in dynamics.THRESHOLDS] + [("grid", "euclidean"), ("tree", "euclidean")]:
    _query(f"experiment_{graph_name}_{metric}" if metric != "euclidean" or graph_name != "cliques" else "experiment_euclidean")(lambda s, d, g=graph_name, m=metric: rounded(dynamics.experiment(GRAPHS[g](s), 30, m, graph=g)))
for prior in ("flow", "kmeans", "dbscan"):
    _query(f"experiment_prior_{prior}")(lambda s, d, p=prior: rounded(estimator.prior_experiment(vectors(s, d), near_graph(s, d), p, n_clusters=10, eps=1.22, min_samples=12)))
_query("recon_graphical_lasso")(lambda s, d: rounded(dynamics.graphical_lasso(user_series(s, d), 0.25)))
