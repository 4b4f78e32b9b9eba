"""Descent: neighbours of neighbours are probably neighbours; rounds of local joins until few edges change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import Metric
from ..functions.rand import derive
from ..operators.graph import offers, random_graph
from ..operators.topk import merge_top_k
from .history import History
from .tables import Tables


def descent_round(graph: DataFrame, vectors: DataFrame, k: int, size: int, seed: int, metric_name: str | Metric = "l2") -> DataFrame:
    """The next graph: offers of the local join merged into the lists; what was listed is old now."""
    return merge_top_k(graph, offers(graph, vectors, size, seed, metric_name, k), k)


def descent_knn(
    vectors: DataFrame, k: int = 30, sample: float = 0.5, et: float = 0.001, seed: int = 0, metric_name: str | Metric = "l2",
    max_rounds: int = 100, history: History | None = None,
) -> DataFrame:
    """u, v, d, is_new: the graph when at most et * n * k entries changed in a round, or after max_rounds."""
    n = vectors.count()
    k = max(0, min(k, n - 1))
    if not k:
        return vectors.sparkSession.createDataFrame([], "u long, v long, d double, is_new boolean")
    size, limit = int(k * sample), int(et * n * k)
    with Tables(vectors.sparkSession) as tables:
        graph = tables.settle(random_graph(vectors, k, derive(seed, 0), metric_name))
        for turn in range(1, max_rounds + 1):
            last, graph = graph, tables.settle(descent_round(graph, vectors, k, size, derive(seed, turn), metric_name))
            tables.drop(last)
            rows, changes = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("is_new").cast("long")), F.lit(0))).first()
            if history is not None:
                history.add("descent", 0, turn, rows, changes)
            if changes <= limit:
                break
        return tables.keep(graph)
