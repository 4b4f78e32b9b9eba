"""Forest: epochs of random partitioning, solving the leaves and merging, until few lists change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import Metric, metric
from ..functions.rand import derive
from ..operators.exact import exact_leaves
from ..operators.leaf import CUTOFF, leaf_knn, leaf_solver
from ..operators.partition import forest_routed, grown_leaves, partition_forest, routed
from ..operators.topk import merge_top_k
from .history import History
from .tables import Tables


def epoch_lists(vectors: DataFrame, k: int, alpha: int, rho: int, seed: int, epoch: int, metric_name: str | Metric = "l2", cutoff: int | None = CUTOFF, trees: int = 1, history: History | None = None, n: int | None = None) -> DataFrame:
    """u, v, d: neighbour lists inside the leaves of one epoch's partitions; without a cutoff every leaf is solved exactly."""
    seeds = [derive(seed, epoch, tree) for tree in range(trees)]
    if cutoff is not None and history is None:
        return grown_leaves(vectors, alpha, rho, seeds, leaf_solver(k, metric(metric_name), cutoff, seeds[0]), metric_name, n)
    report = None if history is None else lambda level, sizes: history.level(epoch, level, sizes)
    grown = partition_forest(vectors, alpha, rho, seeds, metric_name, report=report)
    leaves = routed(vectors, grown[0]) if trees == 1 else forest_routed(vectors, grown)
    return exact_leaves(leaves, k, metric_name) if cutoff is None else leaf_knn(leaves, k, metric_name, cutoff, seeds[0])


def forest_knn(
    vectors: DataFrame, k: int = 30, alpha: int = 150_000, rho: int = 15, tau: float = 0.01, seed: int = 0, metric_name: str | Metric = "l2",
    max_epochs: int = 100, cutoff: int | None = CUTOFF, trees: int = 1, history: History | None = None,
) -> DataFrame:
    """u, v, d, is_new: the graph when at most tau * n * k entries changed in an epoch, or after max_epochs.

    Lists are shorter than k where fewer neighbours were met; a node that was alone in every leaf has no rows. A single leaf
    without a cutoff gives the exact graph, which a second epoch can't change.
    """
    n = vectors.count()
    k = max(0, min(k, n - 1))
    limit, graph = int(tau * n * k), None
    if not k:
        return vectors.sparkSession.createDataFrame([], "u long, v long, d double, is_new boolean")
    with Tables(vectors.sparkSession) as tables:
        for epoch in range(max_epochs):
            lists = epoch_lists(vectors, k, alpha, rho, seed, epoch, metric_name, cutoff, trees, history, n)
            last, graph = graph, tables.settle(merge_top_k(graph, lists, k))
            if last is not None:
                tables.drop(last)
            rows, changes = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("is_new").cast("long")), F.lit(0))).first()
            if history is not None:
                history.add("forest", epoch, 0, rows, changes)
            if changes <= limit or cutoff is None and n <= alpha:
                break
        return tables.keep(graph)
