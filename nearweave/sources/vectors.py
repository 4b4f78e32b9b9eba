"""Reading vectors and writing graphs.

vectors: id BIGINT, vec ARRAY<FLOAT>. edges: u BIGINT, v BIGINT, d DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checked(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Vectors whose rows fail at run time where an id or component is missing or a length differs from ``dim``."""
    bad = F.col("id").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull())
    if dim is not None:
        bad = bad | (F.size("vec") != dim)
    return vectors.select(F.when(bad, F.raise_error(F.concat(F.lit("not a vector of the expected length: id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).otherwise(F.col("id")).cast("long").alias("id"), "vec")


def from_table(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dim: int | None = None) -> DataFrame:
    """Vectors from a table with an id and an array column; only these two columns are read."""
    return checked(table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("vec")), dim)


def read_vectors_parquet(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    return from_table(spark.read.parquet(path), **columns)


def read_vectors_text(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Lines "id f0 f1 ...": further tokens are ignored; too few, or tokens that are no numbers, fail the read."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(tokens.alias("t"))
    vec = F.transform(F.slice("t", 2, dim), lambda x: F.when(x.try_cast("float").isNull(), F.raise_error(F.concat(F.lit("not a number: "), x)).cast("float")).otherwise(x.try_cast("float")))
    return checked(lines.select(F.element_at("t", 1).cast("long").alias("id"), vec.alias("vec")), dim)


def write_vectors_text(vectors: DataFrame, path: str) -> None:
    vectors.select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("string")))).write.text(path)


def ranked(edges: DataFrame) -> DataFrame:
    """Edges with their rank (from 1) in the node's list, by distance and then id."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v")))


def adjacency(edges: DataFrame) -> DataFrame:
    """u and neighbors: ids joined by blanks, nearest first."""
    listed: Column = F.sort_array(F.collect_list(F.struct("d", "v")))
    return edges.groupBy("u").agg(F.array_join(F.transform(listed, lambda x: x["v"].cast("string")), " ").alias("neighbors"))


def write_adjacency_text(edges: DataFrame, path: str) -> None:
    """Lines "u<TAB>v1 v2 ...", one for each node."""
    adjacency(edges).select(F.concat_ws("\t", F.col("u").cast("string"), "neighbors")).write.text(path)


def read_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """u, v, rank from such lines."""
    parts = F.split("value", "\t")
    lists = spark.read.text(path).select(parts[0].cast("long").alias("u"), F.split(F.trim(parts[1]), " ").alias("vs"))
    return lists.select("u", F.posexplode("vs").alias("i", "v")).select("u", F.col("v").cast("long").alias("v"), (F.col("i") + 1).alias("rank"))


def write_edges(edges: DataFrame, path: str) -> None:
    ranked(edges).write.parquet(path)
