"""Connected components by alternating large-star and small-star over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its neighbours: a combined aggregate, and a join by sorting, as both sides grow."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least.hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the least of u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    ties = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return ties.filter("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node and component (its least node) of every node of edges (u long, v long), in a table of the run.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round; the round
    before is deleted then. Rounds end when a round changes nothing; their number grows with the logarithm of the longest
    path. Self loops and repeated or turned edges are allowed; a node with self loops only is its own component; an empty
    table gives an empty table.
    """
    given = tables.settle(edges.select("u", "v").distinct())
    now = tables.settle(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    held = _print_of(now)
    while held[0]:
        last, now = now, tables.settle(_small_star(_large_star(now)))
        tables.drop(last)
        before, held = held, _print_of(now)
        if before == held:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    same = lambda x: x.select(F.col("v").alias("node"), F.col("v").alias("component"))
    every = found.union(same(now)).union(same(given.filter("u = v")))
    out = tables.settle(every.groupBy("node").agg(F.min("component").alias("component")))
    tables.drop(given, now)
    return out
