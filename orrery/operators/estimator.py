"""The whole way from points to labels: graph, prior, greedy merging, scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import entropy, graphs, partition, priors, quality
from orrery.plans.scratch import materialize

AFFINITIES = ("knn", "radius", "rbf")
PRIORS = ("kmeans", "dbscan", "flow", None)


@dataclass
class InformationClustering:
    """Clusters points by maximum decoding information. fit() fills the attributes that end in an underscore.

    mode 'steps' runs the sequential queue for `steps` steps on the contracted graph; 'rounds' merges in distributed rounds for any size.
    """

    affinity: str = "radius"
    n_neighbors: int = 10
    threshold: float = 2.25
    radius: float = 2.25
    gamma: float = 0.25
    join_components: bool = True
    prior: str | None = "flow"
    n_clusters: int = 8
    eps: float = 1.0
    min_samples: int = 5
    steps: int = 100
    mode: str = "steps"
    scores_: dict = field(default_factory=dict)

    def graph(self, points: DataFrame) -> DataFrame:
        """(u, v, w): the graph of the points with isolated ones attached and, if asked for, all components joined."""
        if self.affinity == "knn":
            e = graphs.prune(graphs.knn_graph(points, self.n_neighbors), self.threshold)
        elif self.affinity == "radius":
            e = graphs.radius_graph(points, self.radius)
        elif self.affinity == "rbf":
            e = graphs.rbf_graph(points, self.threshold, self.gamma)
        else:
            raise ValueError(f"affinity must be one of {AFFINITIES}")
        # Edges that repair or join a kernel graph have weights by the gamma as it is given.
        gamma = self.gamma if self.affinity == "rbf" else None
        e = materialize(e.select("u", "v", "w"), "fit-graph")
        e = materialize(e.unionByName(graphs.repair(points, e, gamma)), "fit-repaired")
        return materialize(e.unionByName(graphs.bridge(points, e, gamma)), "fit-joined") if self.join_components else e

    def _prior(self, points: DataFrame, edges: DataFrame) -> DataFrame | None:
        if self.prior == "kmeans":
            return priors.as_partition(priors.kmeans(points, self.n_clusters))
        if self.prior == "dbscan":
            return priors.as_partition(priors.dbscan(points, graphs.radius_pairs(points, self.eps), self.min_samples))
        return priors.flow_partition(edges) if self.prior == "flow" else None

    def fit(self, points: DataFrame) -> InformationClustering:
        points = materialize(graphs.clean_points(points), "fit-points")
        self.edges_ = self.graph(points)
        prior = self._prior(points, self.edges_)
        prior = materialize(prior, "fit-prior") if prior is not None else None
        if self.mode == "steps":
            part, self.trace_ = partition.greedy_steps(self.edges_, prior, self.steps)
        else:
            part, self.trace_ = partition.merge_rounds(self.edges_, prior), None
        self.partition_ = materialize(part, "fit-part")
        self.labels_ = materialize(partition.labels(points, self.partition_), "fit-labels")
        h = entropy.entropy_2d(self.edges_, self.partition_, "count").first()
        self.scores_ = {"h1": h["h1"], "di": entropy.total_di(self.edges_, self.partition_).first()[0], "n_parts": self.partition_.select("cid").distinct().count()}
        self.scores_["prior_di"] = entropy.total_di(self.edges_, prior).first()[0] if prior is not None else 0.0
        self.scores_["di_rate"] = self.scores_["di"] / h["h1"] if h["h1"] else None
        self.scores_["silhouette"] = quality.silhouette(points, self.labels_).first()[0]
        self.scores_["calinski_harabasz"] = quality.calinski_harabasz(points, self.labels_).first()[0]
        return self

    def summary(self) -> DataFrame:
        """(metric, value)."""
        return self.edges_.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in self.scores_.items()], "metric string, value double")


def prior_experiment(points: DataFrame, edges: DataFrame, prior: str, steps: int = 100, n_clusters: int = 8, eps: float = 1.0, min_samples: int = 5) -> DataFrame:
    """(metric, value): what a prior partition of a graph decodes before and after `steps` of greedy merging, and by one-dimensional entropy. prior 'kmeans' and 'dbscan' are refined
    by flow_partition() from what they give; 'flow' starts from single nodes."""
    edges = materialize(edges.select("u", "v", "w"), "experiment-edges")
    start = None
    if prior == "kmeans":
        start = priors.as_partition(priors.kmeans(points, n_clusters))
    elif prior == "dbscan":
        start = priors.as_partition(priors.dbscan(points, graphs.radius_pairs(points, eps), min_samples))
    elif prior != "flow":
        raise ValueError(f"no such prior: {prior}")
    if start is not None:
        nodes = partition.singletons(edges).select("node")
        start = materialize(start.join(nodes, "node", "left_semi"), "experiment-prior")
    flow = materialize(priors.flow_partition(edges, start), "experiment-flow")
    best = materialize(partition.greedy_steps(edges, flow, steps)[0], "experiment-best")
    h = entropy.entropy_2d(edges, best, "count").first()
    before, after = entropy.total_di(edges, flow).first()[0], entropy.total_di(edges, best).first()[0]
    rows = [("h1", h["h1"]), ("prior_di", before), ("di", after), ("di_rate", after / h["h1"] if h["h1"] else None), ("n_parts", best.select("cid").distinct().count())]
    return edges.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "metric string, value double")


def reduce_dimensions(points: DataFrame, k: int = 2) -> DataFrame:
    """(id, x): principal components after centering; points as they are where they have no more than k dimensions. The sign of a component is arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dims = points.select(F.max(F.size("x"))).first()[0] or 0
    if dims <= k:
        return points.select("id", "x")
    m = standardize(points, scale=False)
    d = m.select("id", array_to_vector("x").alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(d).transform(d).select("id", vector_to_array("p").alias("x"))


def standardize(points: DataFrame, scale: bool = True) -> DataFrame:
    """(id, x): each dimension less its mean, by its deviation over all points (1 where that is 0)."""
    long = points.select(F.posexplode("x").alias("k", "v"))
    s = long.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("all"))
    by = (lambda v, a: (v - a["m"]) / F.when(a["s"] > 0, a["s"]).otherwise(1.0)) if scale else (lambda v, a: v - a["m"])
    return points.join(F.broadcast(s)).select("id", F.zip_with("x", "all", by).alias("x"))
