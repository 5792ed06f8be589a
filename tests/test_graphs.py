"""Graph operators: golden values, brute force and properties."""

import itertools
import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions.metrics import METRICS, beta_tail
from orrery.operators import dynamics, entropy, estimator, graphs, partition, priors, quality
from orrery.operators.components import connected_components
from orrery.sources import osm, shapefile

FIXTURE = "0-1 0-2 0-3 1-2 1-3 2-3 2-4 4-5 4-7 5-6 5-7 5-8 6-8 7-8 8-9 9-10 9-12 9-13 10-11 10-12 11-12 11-13 12-13"
TRACE = [0.0, 0.128, 0.287, 0.476, 0.603, 0.763, 0.891, 1.009, 1.136, 1.296, 1.296, 1.345, 1.439]


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([(*map(int, x.split("-")), 1.0) for x in FIXTURE.split()], "u long, v long, w double").persist()
    p = spark.createDataFrame([(n, 0 if n < 4 else 1 if n < 9 else 2) for n in range(14)], "node long, cid long").persist()
    return e, p


def _parts(df):
    return sorted(sorted(r["nodes"]) for r in partition.as_lists(df).collect())


def test_golden_entropy(small):
    e, p = small
    r = entropy.entropy_2d(e, p).first()
    assert (round(r["h1"], 9), round(r["h2"], 9)) == (3.783581521, 2.344778911)
    assert math.isclose(entropy.entropy_1d(e).first()[0], entropy.entropy_1d_partition(e, p).first()[0])
    assert entropy.total_di(e, p).first()[0] == 1.439
    stats = sorted((x["vol"], x["cut_count"]) for x in entropy.part_stats(e, p).collect())
    assert stats == [(13, 1), (16, 2), (17, 1)]
    assert [round(x["delta"], 3) for x in entropy.pair_gains(e, p).orderBy("ci", "cj").collect()] == [0.534, 0.6, 0.63]
    d = {(x["u"], x["v"]): x["delta"] for x in entropy.edge_gains(e).collect()}
    assert (d[(0, 1)], d[(0, 2)], d[(2, 4)], d[(5, 8)], d[(9, 12)], d[(4, 7)]) == (-0.128, -0.118, -0.118, -0.11, -0.11, -0.128)


def test_weighted_cuts(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.5), (1, 2, 1.0), (2, 3, 0.25), (3, 4, 4.0), (3, 5, 0.125), (4, 5, 1.0)], "u long, v long, w double")
    p = spark.createDataFrame([(n, n // 3) for n in range(6)], "node long, cid long")
    a, b = entropy.entropy_2d(e, p).first(), entropy.part_di(e, p).agg(F.sum("di")).first()[0]
    assert (round(a["h1"], 6), round(a["h2"], 6), round(a["di"], 6), round(b, 6)) == (2.426423, 1.479605, 0.946818, 0.860232)


def test_greedy_merging(spark, small):
    e, p = small
    part, trace = partition.greedy_steps(e, steps=20)
    assert [r["di"] for r in trace.orderBy("iter").collect()][:13] == TRACE and _parts(part) == _parts(p)
    assert _parts(partition.greedy_steps(e, steps=10)[0]) == [[0, 1, 2, 3], [4, 5, 7], [6, 8], [9, 10], [11, 12, 13]]
    assert _parts(partition.greedy(e, "di")) == _parts(p)
    cliques = dynamics.ring_of_cliques(spark)
    got, trace = partition.greedy_steps(cliques, steps=60)
    assert _parts(got) == [list(range(5 * c, 5 * c + 5)) for c in range(6)] and trace.agg(F.max("di")).first()[0] == 2.35
    grid, trace = partition.greedy_steps(dynamics.grid_graph(spark), steps=100)
    assert trace.agg(F.max("di")).first()[0] == 1.512 and len(_parts(grid)) == 7
    assert len(_parts(partition.merge_rounds(cliques))) <= 12
    with pytest.raises(ValueError):
        partition.greedy_steps(e, most_parts=3)


def test_rounds_end_when_no_part_gains(spark):
    star = spark.range(1, 121).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    for gain in ("di", "rate"):
        p = partition.merge_rounds(star, gain=gain)
        assert p.count() == 121 and entropy.pair_gains(star, p, gain, adjacent_only=True).where("delta < -1e-12").count() == 0
    with pytest.raises(RuntimeError):
        partition.merge_rounds(star, max_rounds=0)


def test_empty_and_degenerate_graphs(spark):
    none = spark.createDataFrame([], "u long, v long, w double")
    part = spark.createDataFrame([], "node long, cid long")
    assert entropy.degree(none).count() == 0 and entropy.entropy_1d(none).first()[0] is None and connected_components(none).count() == 0
    assert entropy.total_di(none, part).first()[0] is None and partition.merge_rounds(none).count() == 0 and entropy.sizes(none).first()["n_edges"] == 0
    loop = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "u long, v long, w double")
    assert {r["node"]: r["degree"] for r in entropy.degree(loop).collect()} == {1: 5.0, 2: 1.0}
    dirty = spark.createDataFrame([(2, 1, 1.0, 7), (1, 2, 2.0, 7), (None, 1, 1.0, 7), (1, 2, float("nan"), 7), (1, 2, -1.0, 7), (3, 3, None, 7)], "u long, v long, w double, x int")
    assert [tuple(r) for r in entropy.clean_edges(dirty).collect()] == [(1, 2, 3.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.floats(0.1, 5)), min_size=1, max_size=30))
def test_components_and_entropy_properties(spark, edges):
    e = spark.createDataFrame(edges, "u long, v long, w double")
    root = {n: n for x in edges for n in x[:2]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v, _ in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert {r["node"]: r["component"] for r in connected_components(e).collect()} == {n: find(n) for n in root}
    c = entropy.clean_edges(e)
    p = partition.singletons(c).select("node", (F.col("node") % 3).alias("cid"))
    r = entropy.entropy_2d(c, p).first()
    assert r["h1"] >= r["h2"] - 1e-9


def test_long_chain_components(spark):
    e = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(e).select("component").distinct().collect()[0][0] == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (5, 0), (0, 9))] + [np.array([[2.5, 4.0], [2.5, 4.0]])])
    d = spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)] + [(None, [1.0, 1.0], "z"), (900, None, "z"), (901, [float("nan"), 1.0], "z"), (902, [], "z")], "id long, x array<double>, d string")
    return graphs.clean_points(d).persist(), x


def test_pairs_match_brute_force_in_any_blocks(spark, cloud, monkeypatch):
    p, x = cloud
    for block in (2000, 17):
        monkeypatch.setattr(graphs, "BLOCK", block)
        for name in ("euclidean", "canberra", "chebyshev", "pearson"):
            m = METRICS[name](x, x)
            got = {(r["u"], r["v"]): r["d"] for r in graphs.pairs(p, name, high=3.0).collect()}
            want = {(i, j): m[i, j] for i, j in itertools.combinations(range(len(x)), 2) if m[i, j] <= 3.0}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in got)
        m = METRICS["euclidean"](x, x)
        np.fill_diagonal(m, np.inf)
        near = {(r["id"], r["rank"]): r["other"] for r in graphs.nearest(p, 3).collect()}
        for i in range(len(x)):
            assert [near[(i, k)] for k in (1, 2, 3)] == sorted(range(len(x)), key=lambda j: (m[i, j], j))[:3]
        e = graphs.radius_graph(p, 0.6).select("u", "v", "w")
        alone = graphs.isolated(p, e).count()
        fixed = e.unionByName(graphs.repair(p, e))
        assert graphs.repair(p, e).count() == alone and graphs.isolated(p, fixed).count() == 0
        joined = fixed.select("u", "v").unionByName(graphs.bridge(p, fixed).select("u", "v"))
        n = connected_components(fixed).select("component").distinct().count()
        assert graphs.bridge(p, fixed).count() == n - 1 and connected_components(joined).select("component").distinct().count() == 1
    assert graphs.pairs(p.limit(0), "euclidean").count() == 0 and graphs.nearest(p.limit(0), 3).count() == 0
    assert graphs.histogram(p.limit(0), "euclidean").count() == 0


def test_histogram_counts_all_pairs(cloud):
    p, x = cloud
    h = graphs.histogram(p, "manhattan", 10)
    assert h.agg(F.sum("n")).first()[0] == len(x) * (len(x) - 1) // 2
    assert {r["family"] for r in graphs.fitted(p, "euclidean").collect()} == {"norm", "laplace"}


def test_beta_tail_is_the_t_test():
    # Two-sided p-values of r with 8 degrees of freedom, from tables of Student's t.
    assert abs(float(beta_tail(np.array([1 - 0.632**2]), 4.0)[0]) - 0.05) < 1e-3
    assert abs(float(beta_tail(np.array([1 - 0.765**2]), 4.0)[0]) - 0.01) < 1e-3


def test_density_and_quality(spark, cloud):
    p, x = cloud
    got = {r["id"]: r["cluster"] for r in priors.dbscan(p, graphs.radius_pairs(p, 1.0), 4).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20} and got[60] is None
    lab = priors.kmeans(p, 3).withColumnRenamed("cluster", "label")
    assert lab.select("label").distinct().count() == 3
    truth = p.select("id", F.floor(F.col("id") / 20).cast("int").alias("label"))
    m = METRICS["euclidean"](x, x)
    t = np.arange(len(x)) // 20
    s = []
    for i in range(len(x)):
        own = [m[i, j] for j in range(len(x)) if t[j] == t[i] and j != i]
        a, b = np.mean(own), min(np.mean(m[i, t == c]) for c in set(t) if c != t[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(quality.silhouette(p, truth).first()[0], np.mean(s))
    assert quality.calinski_harabasz(p, truth).first()[0] > 100
    hull = quality.outlines(p, truth.select(F.col("id").alias("node"), F.col("label").cast("long").alias("cid"))).collect()
    assert all(r["hull"] is None or len(r["hull"]) >= 3 for r in hull) and sum(r["num"] for r in hull) == len(x)


def test_estimator(spark, cloud):
    p, _ = cloud
    for prior, mode in (("dbscan", "steps"), ("flow", "rounds")):
        m = estimator.InformationClustering(affinity="radius", radius=1.0, prior=prior, eps=1.0, min_samples=4, steps=40, mode=mode).fit(p)
        assert m.labels_.count() == p.count() and m.scores_["n_parts"] < p.count() and 0 < m.scores_["di_rate"] < 1
    with pytest.raises(ValueError):
        estimator.InformationClustering(affinity="other").fit(p)
    z = estimator.standardize(p).select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in z)


def test_roads_and_files(spark, rows, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lon="10.5" lat="20"/><node id="2" lon="11" lat="21"/><way id="5"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="3"/></way><way id="6"><nd ref="3"/></way></osm>'.replace("id=", "id="))
    n = osm.read_nodes(spark, str(tmp_path / "a.osm"))
    w = osm.read_ways(spark, str(tmp_path / "a.osm"))
    assert rows(n) == [(1, 10.5, 20.0), (2, 11.0, 21.0)] and rows(osm.road_graph(w)) == [(1, 2, 1.0), (2, 3, 1.0)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (4, 6)], "u long, v long").withColumn("w", F.lit(1.0))
    assert rows(osm.simplify(e)) == [(1, 4, 3), (4, 5, 1), (4, 6, 1)]
    again, m = osm.relabel(e, spark.createDataFrame([(6, 0), (5, 1), (4, 2), (3, 3), (2, 4), (1, 5)], "node long, first long"))
    assert rows(m)[0] == (1, 5) and again.count() == 5
    ring = osm.ring_order(spark.createDataFrame([(1, 2), (3, 2), (3, 1)], "a long, b long"))
    assert [r["node"] for r in ring.orderBy("seq").collect()] == [1, 2, 3, 1]
    assert osm.ring_order(spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")).count() == 2
    shapefile.write_shp([(1.0, 2.0), (3.5, -4.0)], str(tmp_path / "p.shp"))
    assert [(r["x"], r["y"]) for r in shapefile.read_points(spark, str(tmp_path)).orderBy("record").collect()] == [(1.0, 2.0), (3.5, -4.0)]
    shapefile.write_edge_list(e, str(tmp_path / "edges"))
    lines = [x for f in sorted((tmp_path / "edges").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "6" and lines[1].split()[:2] == ["1", "2"] and len(lines) == 6
    shapefile.write_trace(spark.createDataFrame([(0, 0.5), (1, 0.75)], "iter int, di double"), str(tmp_path / "trace"))
    assert spark.read.text(str(tmp_path / "trace")).count() == 2
    shapefile.write_geojson(spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>"), str(tmp_path / "geo"))
    assert '"Point"' in spark.read.text(str(tmp_path / "geo")).first()[0]
    assert shapefile.gexf_lines(e).count() == 3 + 6 + 5


def test_dynamics(spark, rows):
    g = dynamics.ring_of_cliques(spark).withColumn("graph", F.lit(0).cast("long"))
    assert g.count() == 66 and dynamics.grid_graph(spark).count() == 49 and dynamics.preferential_graph(spark).count() == 29
    for model in ("branching", "ising", "spin_glass"):
        t = dynamics.simulate(g, model, 200)
        assert t.count() == 30 and t.select(F.size("x")).distinct().collect() == [(200,)] and rows(t) == rows(dynamics.simulate(g, model, 200))
    ts = dynamics.simulate(g, "ising", 600).select(F.col("node").alias("id"), "x")
    found = dynamics.by_degree(dynamics.ising_likelihood(ts), 30, 4.4)
    truth = {(r["u"], r["v"]) for r in g.collect()}
    assert len({(r["u"], r["v"]) for r in found.collect()} & truth) > 40
    assert dynamics.mutual_information(ts).where("w < -1e-9").count() == 0 and dynamics.partial_correlations(ts).count() == 435
    assert dynamics.hamming(g, g, 30).first()[0] == 0
    r = dynamics.spectral_distance(g, dynamics.grid_graph(spark), 30).first()
    assert r["spectral"] > 0 and math.isclose(r["hamming"], dynamics.hamming(g, dynamics.grid_graph(spark), 30).first()[0])
    assert rows(dynamics.reciprocal(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "u long, v long"))) == [(1, 2)]
    long = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "node long, t int, value double")
    assert rows(dynamics.series(long)) == [(1, [5.0, 6.0]), (2, [7.0])] and dynamics.lagged(long).where("before IS NULL").count() == 2


def test_partial_correlations_of_many_series(spark, monkeypatch):
    monkeypatch.setattr(dynamics, "MOST_NODES", 20)
    for n, times in ((40, 12), (8, 30)):
        x = np.random.default_rng(6).normal(size=(n, times)).cumsum(1)
        x[3] = 1.0
        c = np.cov(x)
        k = np.linalg.inv(0.9 * c + 0.1 * np.eye(n) * np.trace(c) / n)
        want = -k / np.sqrt(np.outer(np.diag(k), np.diag(k)))
        p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        got = {(r["u"], r["v"]): r["w"] for r in dynamics.partial_correlations(p).collect()}
        assert len(got) == n * (n - 1) // 2 and all(math.isclose(w, want[i, j], abs_tol=1e-9) for (i, j), w in got.items())


def test_degree_threshold_follows_the_users(spark, tmp_path):
    from orrery.plans.graph_queries import QUERIES

    rng = np.random.default_rng(3)
    e = [(u, datetime(2024, 1, 1 + k), float(rng.normal())) for u in range(30) for k in range(9)]
    spark.createDataFrame(e, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["degree_threshold"](spark, str(tmp_path)).count() == 30 * 4 / 2


def test_degree_threshold_with_events_without_time(spark, tmp_path, rows):
    from orrery.plans.graph_queries import QUERIES

    rng = np.random.default_rng(3)
    timed = [(u, datetime(2024, 1, 1 + k), float(rng.normal())) for u in range(30) for k in range(9)]
    none = [(0, None, 5.0), (1, None, None), (None, None, 1.0)]
    for name, e in {"timed": timed, "some": timed + none, "user": timed + none + [(99, None, 5.0)], "no": none}.items():
        spark.createDataFrame(e, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / name / "events.parquet"))
    want, some, user, no = (rows(QUERIES["degree_threshold"](spark, str(tmp_path / name))) for name in ("timed", "some", "user", "no"))
    # A user without any time is a user, whose series has no correlations.
    assert some == want and set(user) > set(want) and len(user) == 31 * 4 / 2 and not no and all(r[1] < 99 for r in user)


def test_compare_store_and_spectral(spark, rows, tmp_path):
    from orrery.sources import store

    g, h = dynamics.ring_of_cliques(spark), dynamics.grid_graph(spark)
    got = {(r["name"], r["metric"]): r["value"] for r in dynamics.compare_graphs(g, {"same": g, "grid": h}, 30).collect()}
    assert got[("same", "hamming")] == 0 and got[("same", "di")] == got[("true", "di")] and got[("grid", "combined")] > 0
    assert priors.spectral(g, 6).count() == 30
    store.save(str(tmp_path), edges=g, partition=partition.singletons(g))
    assert rows(store.load(spark, str(tmp_path), "edges")) == rows(g) and store.load(spark, str(tmp_path), "partition").count() == 30
    with pytest.raises(ValueError):
        store.save(str(tmp_path), other=g)
    gray = spark.createDataFrame([(1, 2, 0), (1, 3, 255)], "u long, v long, gray int")
    assert [r["color"] for r in dynamics.gray_colors(gray, {100: "black"}).orderBy("v").collect()] == [None, "black"]


def test_strong_pairs_leave_their_blocks_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 40)
    monkeypatch.setattr(graphs, "STEP", 300)
    x = np.random.default_rng(8).normal(size=(150, 12))
    x[100:130] = x[:30]
    x[7] = 1.0
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.corrcoef(x)
    every = sorted((-round(abs(c[i, j]), 12), i, j) for i in range(150) for j in range(i + 1, 150) if not np.isnan(c[i, j]))
    # Thirty copies less the one without variation are 29 equal pairs: a cut among them takes the smaller ends.
    for degree in (0.2, 2.0, 1000.0):
        n = round(150 * degree / 2)
        got = [(r["u"], r["v"]) for r in dynamics.correlated_by_degree(p, degree).collect()]
        assert sorted(got) == sorted((i, j) for _, i, j in every[:n])
    assert graphs.strongest_pairs(p, "pearson_r", 15).count() < 15 * 40 < len(every)
    assert graphs.strongest_pairs(p, "pearson_r", 0).count() == 0 == dynamics.correlated_by_degree(p.limit(0), 4).count()
