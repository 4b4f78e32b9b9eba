"""Quality and shape of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(result: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: hits, total, recall of the exact graph's edges."""
    hit = exact.select("u", "v").join(result.select("u", "v").distinct().withColumn("hit", F.lit(1)), ["u", "v"], "left")
    return hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.count("*").alias("total")).withColumn("recall", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 5)))


def degree_stats(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: nodes, edges, least and largest out-degree; nodes without neighbours count with 0."""
    degrees = vectors.select(F.col("id").alias("u")).join(edges.groupBy("u").agg(F.count("*").alias("degree")), "u", "left")
    degrees = degrees.withColumn("degree", F.coalesce("degree", F.lit(0)))
    return degrees.agg(F.count("*").alias("nodes"), F.sum("degree").cast("long").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """v and how many nodes list it."""
    return edges.groupBy("v").agg(F.count("*").alias("in_degree"))


def invariants(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """degree_stats with self_loops, duplicates and unknown (ends that are no nodes)."""
    known = vectors.select(F.col("id").alias("v"))
    loops = edges.agg(F.coalesce(F.sum((F.col("u") == F.col("v")).cast("long")), F.lit(0)).alias("self_loops"), (F.count("*") - F.count_distinct("u", "v")).alias("duplicates"))
    unknown = edges.join(known, "v", "left_anti").agg(F.count("*").alias("unknown"))
    one = F.lit(1).alias("_k")
    return degree_stats(edges, vectors).withColumn("_k", F.lit(1)).join(loops.select("*", one), "_k").join(unknown.select("*", one), "_k").drop("_k")
