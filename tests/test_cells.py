"""Neighbours in cells, components with hubs, and the smaller graph operators, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import components, dynamics, graphs, partition, priors, quality
from orrery.sources import osm


def _points(spark, seed=1):
    rng = np.random.default_rng(seed)
    # A crowded spot, a sparse field, one place with many points, and one point far out.
    xy = np.concatenate([rng.normal(0, 0.01, (80, 2)), rng.uniform(-5, 5, (60, 2)), np.full((30, 2), 2.5), [[400.0, 400.0]]])
    return xy, spark.createDataFrame([(k, [float(a), float(b)], 1.0) for k, (a, b) in enumerate(xy)], "id long, x array<double>, d double")


def test_nearest_in_cells_is_that_of_all_pairs(spark):
    xy, p = _points(spark)
    dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for k in (1, 4):
        want = {(i, j, r + 1) for i in range(len(xy)) for r, j in enumerate(sorted((j for j in range(len(xy)) if j != i), key=lambda j: (dist[i, j], j))[:k])}
        assert {(r["id"], r["other"], r["rank"]) for r in graphs.nearest(p, k).collect()} == want
    far = spark.createDataFrame([(1000, [-900.0, 3.0]), (1001, [0.0, 0.0])], "id long, x array<double>")
    for r in graphs.nearest_of(far, p).collect():
        q = np.array([-900.0, 3.0] if r["id"] == 1000 else [0.0, 0.0])
        assert r["other"] == np.argmin(np.sqrt(((xy - q) ** 2).sum(1)))
    assert graphs.nearest(p.limit(0), 3).count() == 0 and graphs.nearest(p.limit(1), 3).count() == 0


def test_repair_and_bridge_in_cells_agree_with_all_pairs(spark, monkeypatch):
    _, p = _points(spark, 2)
    p = p.where("id < 80 OR id >= 135 OR id % 2 = 0")
    e = graphs.radius_graph(p, 0.05).select("u", "v", "w")
    got = [sorted(tuple(r) for r in d.select("u", "v").collect()) for d in (graphs.repair(p, e), graphs.bridge(p, e))]
    monkeypatch.setattr(graphs, "CELL_DIMS", 0)
    want = [sorted(tuple(r) for r in d.select("u", "v").collect()) for d in (graphs.repair(p, e), graphs.bridge(p, e))]
    assert got == want and len(got[1]) > 10
    none = e.limit(0)
    assert graphs.repair(p.limit(5), none).count() == 4


def test_kernel_weights(spark):
    d = spark.createDataFrame([(0.5,), (1e-4,), (0.0,)], "d double")
    w = [r[0] for r in d.select(graphs.rbf_weight(F.col("d"), 0.25)).collect()]
    assert math.isclose(w[0], math.sqrt(math.log(math.exp(-0.25 * 0.25) + 1e-5) / -0.25) / (0.5 + 1e-5)) and w[1:] == [0.0, 0.0]


def test_components_with_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    star = [(0, k) for k in range(1, 1000)]
    chain = [(k, k + 1) for k in range(2000, 2300)]
    rows = star + chain + [(5000, 5000), (None, 1), (0, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1000)}, **{k: 2000 for k in range(2000, 2301)}, 5000: 5000}
    monkeypatch.setattr(components, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame(chain, "u long, v long"))


def test_ordered_pruning(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (0, 2, 9.0), (3, 4, 8.0), (4, 5, 7.0), (3, 6, 6.0), (7, 8, 20.0)], "u long, v long, d double").withColumn("w", 1 / F.col("d"))
    got = {(r["u"], r["v"]): r["w"] for r in graphs.prune(e, 1.0, "exact").collect()}
    # 0 drops its long edge; 3 keeps the nearest of two, 4 then has a single edge left; 7 and 8 have one.
    assert set(got) == {(0, 1), (3, 6), (4, 5), (7, 8)} and math.isclose(got[3, 6], 1 / (6 + 1e-5)) and got[4, 5] == 1 / 7
    assert graphs.prune(e.limit(0), 1.0, "exact").count() == 0
    lax = {(r["u"], r["v"]) for r in graphs.prune(e, 1.0).collect()}
    assert lax == {(0, 1), (0, 2), (3, 6), (4, 5), (7, 8)}


def test_graphical_lasso_meets_its_conditions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 300))
    x = base.copy()
    x[1] += 0.9 * x[0]
    x[2] += 0.8 * x[1]
    x[5] += 0.9 * x[4]
    d = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)] + [(9, [1.0] * 300)], "id long, x array<double>")
    penalty = 0.2
    got = {(r["u"], r["v"]): r["w"] for r in dynamics.graphical_lasso(d, penalty).collect()}
    assert {(0, 1), (1, 2), (4, 5)} <= set(got) <= {(0, 1), (1, 2), (0, 2), (4, 5)}
    # The dual problem, by gradients: the covariance of greatest determinant within the penalty of the one given.
    c = np.corrcoef(x[:3])
    w = c.copy()
    for _ in range(20_000):
        g = np.linalg.inv(w)
        np.fill_diagonal(g, 0)
        w = np.clip(w + 0.01 * g, c - penalty * (1 - np.eye(3)), c + penalty * (1 - np.eye(3)))
    k = np.linalg.inv(w)
    for i, j in ((0, 1), (1, 2), (0, 2)):
        assert math.isclose(got.get((i, j), 0.0), -k[i, j] / math.sqrt(k[i, i] * k[j, j]), abs_tol=1e-5)
    # Of a pair by itself the solution is known: its correlation shrunk by the penalty.
    r = np.corrcoef(x[4], x[5])[0, 1] - penalty
    assert math.isclose(got[4, 5], r, abs_tol=1e-6)
    assert dynamics.graphical_lasso(d.limit(0), penalty).count() == 0


def test_attributes_fits_and_outlines(spark):
    n = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, None, 9)], "id long, name string, x_0 int")
    p = spark.createDataFrame([(1, [0.5, 1.5]), (2, [2.0, None])], "id long, x array<double>")
    assert sorted((r["id"], r["x_0"], r["x_1"]) for r in graphs.with_attributes(n, p).collect() if r["id"] < 3) == [(1, 0.5, 1.5), (2, 2.0, None)] and graphs.with_attributes(n, p).count() == 3
    rng = np.random.default_rng(4)
    q = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate(rng.standard_t(3, 300))], "id long, x array<double>")
    t = graphs.fitted_t(q, "euclidean").first()
    assert t["scale"] > 0 and 1 <= t["df"] <= 200 and graphs.fitted_t(q.limit(0), "euclidean").count() == 0
    # A square of 4 x 4 with a point in each corner of the grid and a hole in the middle, and one point apart.
    grid = [(i, j) for i in range(5) for j in range(5) if not (1 <= i <= 3 and 1 <= j <= 3)] + [(50, 50)]
    s = spark.createDataFrame([(k, [float(a), float(b)]) for k, (a, b) in enumerate(grid)], "id long, x array<double>")
    part = s.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("cid"))
    sides = {(grid[r["u"]], grid[r["v"]]) for r in quality.alpha_outlines(s, part, 0.75).collect()}
    assert {tuple(sorted(x)) for x in sides} >= {((0, 0), (0, 1)), ((4, 3), (4, 4)), ((0, 4), (1, 4))} and not any((50, 50) in x for x in sides)
    assert quality.alpha_outlines(s.limit(0), part, 0.75).count() == 0


def test_ring_lines(spark):
    rows = [(1, k, (k + 1) % 9) for k in range(9)] + [(1, 3, 4), (1, 3, 8), (2, 5, 7), (2, 7, 6), (2, 6, 5), (3, 1, 1), (3, None, 2), (4, 0, 1), (4, 1, 2)]
    got = sorted(tuple(r) for r in osm.ring_lines(spark.createDataFrame(rows, "line long, a long, b long")).collect() if r["line"] < 3)
    assert got == [(1, k, k) for k in range(9)] + [(2, 0, 5), (2, 1, 7), (2, 2, 6)]
    assert osm.ring_lines(spark.createDataFrame(rows, "line long, a long, b long").limit(0)).count() == 0


def test_flow_partition_finds_cliques(spark):
    p = priors.flow_partition(dynamics.ring_of_cliques(spark, 4, 4))
    assert sorted(r["nodes"] for r in partition.as_lists(p).collect()) == [[4 * c + k for k in range(4)] for c in range(4)]
    moves = priors.map_moves(dynamics.ring_of_cliques(spark, 4, 4), p)
    assert moves.count() == 0 and priors.flow_partition(dynamics.ring_of_cliques(spark).limit(0)).count() == 0
    # A node in the wrong part goes where it belongs, and the gain is what the codelength loses.
    g = dynamics.ring_of_cliques(spark, 4, 4)
    wrong = p.withColumn("cid", F.when(F.col("node") == 6, F.lit(0)).otherwise(F.col("cid")).cast("long"))
    m = {r["node"]: r for r in priors.map_moves(g, wrong).collect()}
    right = wrong.withColumn("cid", F.when(F.col("node") == 6, F.lit(m[6]["cid"])).otherwise(F.col("cid")))
    assert math.isclose(priors.codelength(g, right).first()[0] - priors.codelength(g, wrong).first()[0], m[6]["delta"], abs_tol=1e-9)


def test_alpha_outlines_of_crowds_meet_the_definition(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.25, (120, 2)) for c in ((0, 0), (1.5, 0.4), (-4.0, 3.0))] + [rng.uniform(-3, 4, (40, 2)), np.round(rng.uniform(5, 6.5, (120, 2)), 1)])
    s = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, [0.0, 0.0]), (901, [0.0, 0.0])], "id long, x array<double>")
    cid = F.when(F.col("id") % 7 == 0, 2).otherwise(1).cast("long")
    r = 0.3
    want = set()
    for part in (1, 2):
        at = {}
        for k, v in [*enumerate(x.tolist()), (900, [0.0, 0.0]), (901, [0.0, 0.0])]:
            if (2 if k % 7 == 0 else 1) == part:
                at.setdefault(tuple(v), k)
        ids, y = np.array(list(at.values())), np.array(list(at))
        for i, j in ((i, j) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j]):
            dx, dy = y[j] - y[i]
            if math.sqrt(dx * dx + dy * dy) <= 2 * r:
                h = math.sqrt(max(0, r * r / (dx * dx + dy * dy) - 0.25))
                others = np.delete(y, [i, j], axis=0)
                if any(not (((others - (y[i] + y[j]) / 2 - [-k * dy * h, k * dx * h]) ** 2).sum(1) < r * r - 1e-9).any() for k in (1, -1)):
                    want.add((part, ids[i], ids[j]))
    got = quality.alpha_outlines(s, s.select(F.col("id").alias("node"), cid.alias("cid")), r)
    assert [(c.cid, c.u, c.v) for c in got.select("cid", "u", "v").orderBy("cid", "u", "v").collect()] == sorted(want) and len(want) > 100
    # Where a crowd has points all around, none of them meets another: only those near a void are written again.
    written = []
    keep, quality.materialize = quality.materialize, lambda df, name: written.append((name, keep(df, name))) or written[-1][1]
    try:
        crowd = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.uniform(0, 2, (4000, 2)))], "id long, x array<double>")
        assert quality.alpha_outlines(crowd, crowd.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("cid")), r).count() > 20
    finally:
        quality.materialize = keep
    assert dict(written)["outline-open"].count() < 1000


def test_links_join_what_all_edges_of_a_radius_join(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FEW", 0)
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.uniform(0, 9, (90, 2)), rng.normal(2.0, 0.2, (150, 2)), np.round(rng.uniform(0, 9, (60, 2)))])
    x = np.concatenate([x, x[:20], np.full((3, 2), 50.0)])
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").cache()
    every = {(e.u, e.v) for e in graphs.radius_graph(p, 0.9).collect()}
    links = {(e.u, e.v) for e in graphs.radius_links(p, 0.9).collect()}
    assert links <= every and len(links) < len(every) / 3

    def joined(pairs):
        of = {k: {k} for k in range(len(x))}
        for u, v in pairs:
            if of[u] is not of[v]:
                of[u] |= of[v]
                for k in of[v]:
                    of[k] = of[u]
        return {frozenset(c) for c in of.values()}

    assert joined(links) == joined(every) and len(joined(every)) > 3


def test_graphical_lasso_of_many_and_of_equal_series(spark, monkeypatch):
    from orrery.operators import lasso

    def dense(c: np.ndarray, penalty: float) -> np.ndarray:
        n = len(c)
        z, dual = np.eye(n), np.zeros((n, n))
        for _ in range(6_000):
            e, q = np.linalg.eigh(z - dual - c)
            a = (q * ((e + np.sqrt(e * e + 4)) / 2)) @ q.T + dual
            z = np.sign(a) * np.maximum(np.abs(a) - penalty * (1 - np.eye(n)), 0)
            dual = a - z
        return z

    monkeypatch.setattr(dynamics, "MOST_NODES", 20)
    monkeypatch.setattr(graphs, "BLOCK", 15)
    for name, small in (("PIVOT", 8), ("ROWS", 16), ("IN_MEMORY", 100)):
        monkeypatch.setattr(lasso, name, small)
    base = np.random.default_rng(5).normal(size=(34, 14))
    # More series than the bound was, fewer times than series, and up to four equal ones; one has no variation.
    x = np.concatenate([base, base[:9], base[:9] * 2 + 3, base[:4], np.ones((1, 14))])
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    for penalty in (0.25, 0.6):
        got = {(r["u"], r["v"]): r["w"] for r in dynamics.graphical_lasso(d, penalty).collect()}
        z = dense(np.corrcoef(x[:-1]), penalty)
        want = -z / np.sqrt(np.outer(np.diag(z), np.diag(z)))
        assert all(u < v for u, v in got) and (0, 34) in got
        for i in range(len(z)):
            for j in range(i + 1, len(z)):
                assert math.isclose(got.get((i, j), 0.0), want[i, j], abs_tol=1e-6), (i, j)
