"""The front door: a graph builder over a table of vectors, configured by keyword instead of command-line keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.distance import Metric
from ..operators.exact import exact_knn
from ..operators.metrics import degree_stats, invariants, recall
from ..sources.vectors import read_vectors_text, write_adjacency_text, write_edges
from .descent import descent_knn
from .forest import forest_knn
from .history import History


class KnnGraph:
    """``KnnGraph(vectors, k=10).forest(alpha=150_000)``; the last build's rounds are in ``history``."""

    def __init__(self, vectors: DataFrame, k: int = 30, metric: str | Metric = "l2", seed: int = 0):
        self.vectors, self.k, self.metric, self.seed = vectors, k, metric, seed
        self.history = History()
        self.edges: DataFrame | None = None

    @classmethod
    def from_text(cls, spark: SparkSession, path: str, dim: int, **options) -> KnnGraph:
        return cls(read_vectors_text(spark, path, dim), **options)

    def exact(self, **options) -> DataFrame:
        self.edges = exact_knn(self.vectors, self.k, self.metric, **options)
        return self.edges

    def forest(self, **options) -> DataFrame:
        self.history = History()
        self.edges = forest_knn(self.vectors, self.k, metric_name=self.metric, seed=self.seed, history=self.history, **options)
        return self.edges

    def descent(self, **options) -> DataFrame:
        self.history = History()
        self.edges = descent_knn(self.vectors, self.k, metric_name=self.metric, seed=self.seed, history=self.history, **options)
        return self.edges

    def recall(self, exact: DataFrame) -> DataFrame:
        return recall(self.edges, exact)

    def stats(self) -> DataFrame:
        return degree_stats(self.edges, self.vectors)

    def invariants(self) -> DataFrame:
        return invariants(self.edges, self.vectors)

    def write_text(self, path: str) -> None:
        write_adjacency_text(self.edges, path)

    def write(self, path: str) -> None:
        write_edges(self.edges, path)

    def progress(self) -> DataFrame:
        return self.history.frame(self.vectors.sparkSession)
