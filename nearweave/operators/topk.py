"""Bounded neighbour lists: top-k, merging with freshness, and counting changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def top_k(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; ties by the smaller id. Spark cuts the lists before the shuffle, too."""
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).filter(F.col("_r") <= k).drop("_r")


def merge_top_k(old: DataFrame | None, offers: DataFrame, k: int) -> DataFrame:
    """u, v, d, is_new: the k nearest distinct ids of both; an id that was in the old list stays old.

    One shuffle: removing repeated ids and cutting the lists keep the dealing by node.
    """
    both = offers.select("u", "v", "d", F.lit(True).alias("is_new"))
    if old is not None:
        both = both.unionByName(old.select("u", "v", "d", F.lit(False).alias("is_new")))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = both.repartition(n, "u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("is_new").alias("is_new"))
    return top_k(single, k)


def count_changes(merged: DataFrame) -> int:
    """Entries that were not in the lists before."""
    return merged.filter("is_new").count()
