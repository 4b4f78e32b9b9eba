"""``python -m nearweave forest --input vectors.txt --dim 128 --output graph``: one build from a path to a path."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.engine import KnnGraph
from .sources.vectors import read_vectors_parquet

#: Keys of each kind of build with their defaults.
KEYS = {"forest": {"alpha": 150_000, "rho": 15, "tau": 0.01}, "descent": {"sample": 0.5, "et": 0.001}, "exact": {}}


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="nearweave", description="Build a k-nearest-neighbour graph and write it as text.")
    kinds = parser.add_subparsers(dest="build", required=True)
    for build, keys in KEYS.items():
        kind = kinds.add_parser(build)
        kind.add_argument("--input", required=True, help="lines of an id and --dim numbers; without --dim, Parquet with vec_id and embedding")
        kind.add_argument("--output", default="result")
        kind.add_argument("--dim", type=int)
        kind.add_argument("--k", type=int, default=30)
        kind.add_argument("--metric", default="l2", choices=("l2", "l1", "cosine"))
        kind.add_argument("--seed", type=int, default=0)
        for key, value in keys.items():
            kind.add_argument(f"--{key}", type=type(value), default=value)
    return parser.parse_args(words)


def build(spark: SparkSession, given: argparse.Namespace) -> KnnGraph:
    """The graph of a command line, written to its output."""
    options = {"k": given.k, "metric": given.metric, "seed": given.seed}
    graph = KnnGraph.from_text(spark, given.input, given.dim, **options) if given.dim else KnnGraph(read_vectors_parquet(spark, given.input), **options)
    getattr(graph, given.build)(**{key: getattr(given, key) for key in KEYS[given.build]})
    graph.write_text(given.output)
    return graph


if __name__ == "__main__":
    graph = build(SparkSession.builder.appName("nearweave").getOrCreate(), arguments())
    graph.progress().show(1000, False)
