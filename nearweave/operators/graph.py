"""Steps of neighbour descent on edge tables (u, v, d, is_new)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, metric
from ..functions.rand import PRIME, derive, hash_two
from ..plans.tables import settle
from .exact import pair_distances
from .leaf import matrix

#: Pairs that are measured at once.
PAIRS = 1 << 16


def dense_index(ids: DataFrame) -> tuple[DataFrame, int]:
    """id and index (0 to n - 1 in order of ids), and n. No step gathers the ids in one task."""
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if n and high - low + 1 == n:
        return ids.select("id", (F.col("id") - low).alias("index")), n
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(at, at + batch.num_rows), pa.int64())], names=["id", "part", "place"])
            at += batch.num_rows

    placed = settle(ids.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(number, "id long, part int, place long"))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    begin, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, begin))
        begin += sizes[part]
    offsets = ids.sparkSession.createDataFrame(rows, "part int, begin long")
    return placed.join(F.broadcast(offsets), "part").select("id", (F.col("begin") + F.col("place")).alias("index")), n


def random_neighbors(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """u, v: k distinct random others for every node (n - 1 where there are fewer), by hash."""
    indexed, n = dense_index(ids)
    k = min(k, n - 1)
    if k <= 0:
        return ids.sparkSession.createDataFrame([], "u long, v long")
    if n <= 8 * k + 64:  # so few nodes that draws would often repeat: order all others by hash (n is bounded by k here)
        u, v = ids.select(F.col("id").alias("u")), ids.select(F.col("id").alias("v"))
        order = Window.partitionBy("u").orderBy(hash_two(F.col("u"), F.col("v"), seed), "v")
        return u.join(v, F.col("u") != F.col("v")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v")
    draws = ids.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 * k + 16).cast("long"))).alias("j"))
    draw = hash_two(F.col("u"), F.col("j"), seed)
    if n > PRIME:  # one hash would never draw the rest
        draw = draw * PRIME + hash_two(F.col("u"), F.col("j"), derive(seed, 1))
    drawn = draws.select("u", "j", F.pmod(draw, F.lit(n)).alias("index"))
    named = drawn.join(indexed.withColumnRenamed("id", "v"), "index").filter("u <> v").groupBy("u", "v").agg(F.min("j").alias("j"))
    order = Window.partitionBy("u").orderBy("j")
    named = settle(named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v", "j"))
    short = ids.select(F.col("id").alias("u")).join(named.groupBy("u").count().filter(F.col("count") >= k), "u", "left_anti")
    if not short.isEmpty():  # hardly ever: the draws gave fewer than k others, so those that follow the node fill its list
        steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("step")
        after = short.join(indexed.withColumnRenamed("id", "u"), "u").select("u", "index", steps).select("u", (F.col("step") + 2 * k + 16).alias("j"), F.pmod(F.col("index") + F.col("step"), F.lit(n)).alias("index"))
        more = after.join(indexed.withColumnRenamed("id", "v"), "index").select("u", "v", "j")
        named = named.unionByName(more).groupBy("u", "v").agg(F.min("j").alias("j"))
    return named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v")


def random_graph(vectors: DataFrame, k: int, seed: int, metric_name: str | Metric = "l2") -> DataFrame:
    """u, v, d, is_new: random lists with true distances, all new."""
    return pair_distances(random_neighbors(vectors.select("id"), k, seed), vectors, metric_name).select("u", "v", "d", F.lit(True).alias("is_new"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """c, w, d, is_new: for each node c, the nodes w that list it. A projection."""
    return edges.select(F.col("v").alias("c"), F.col("u").alias("w"), "d", "is_new")


def sample_reverse(edges: DataFrame, size: int, seed: int) -> DataFrame:
    """At most ``size`` new and as many old reverse neighbours of each node, by hash; this bounds hubs."""
    order = Window.partitionBy("c", "is_new").orderBy(hash_two(F.col("c"), F.col("w"), seed), "w")
    return reverse_edges(edges).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).select("c", "w", "is_new")


def neighborhoods(edges: DataFrame, size: int, seed: int) -> DataFrame:
    """c, w, is_new: listed and sampled reverse neighbours; one row for each neighbour and freshness."""
    forward = edges.select(F.col("u").alias("c"), F.col("v").alias("w"), "is_new")
    return forward.unionByName(sample_reverse(edges, size, seed)).distinct()


def local_join(edges: DataFrame, size: int, seed: int) -> DataFrame:
    """x, y (x < y): pairs that share a neighbourhood, at least one side new, each once.

    A neighbourhood has at most k + 2 * size members, so the pairs of a node are bounded whatever its popularity.
    """
    near = neighborhoods(edges, size, seed)
    a = near.select("c", F.col("w").alias("x"), F.col("is_new").alias("x_new"))
    b = near.select("c", F.col("w").alias("y"), F.col("is_new").alias("y_new"))
    return a.join(b, "c").filter((F.col("x") < F.col("y")) & (F.col("x_new") | F.col("y_new"))).select("x", "y").distinct()


def offers(edges: DataFrame, vectors: DataFrame, size: int, seed: int, metric_name: str | Metric = "l2", k: int | None = None) -> DataFrame:
    """u, v, d: the pairs of the local join offered to both of their ends; of each neighbourhood's, the k nearest for each end.

    Vectors travel once to each member of a neighbourhood, and each neighbourhood's pairs are measured in one place. More
    than k offers of one neighbourhood can't all be among the k nearest, so that cutting them loses nothing. The same pair
    may be offered by several neighbourhoods; merging removes repeats.
    """
    m = metric(metric_name)
    near = neighborhoods(edges, size, seed).groupBy("c", "w").agg(F.max("is_new").alias("is_new"))
    members = near.join(vectors.select(F.col("id").alias("w"), "vec"), "w").select("c", "w", "is_new", "vec")
    dealt = members.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c").sortWithinPartitions("c", "w")

    def joined(rows: pa.Table) -> pa.RecordBatch:
        """Whole neighbourhoods, one after the other."""
        c, w, new = (np.asarray(rows.column(i).combine_chunks()) for i in range(3))
        x = matrix(rows.column(3), rows.num_rows)
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        ends = np.append(head[1:], len(c))
        one, two = (np.concatenate(z) for z in zip(*([a + t for t in _triangle(b - a)] for a, b in zip(head.tolist(), ends.tolist()))))
        keep = new[one] | new[two]
        one, two = one[keep], two[keep]
        d = np.concatenate([m.rows(x[one[i : i + PAIRS]], x[two[i : i + PAIRS]]) for i in range(0, len(one), PAIRS)]) if len(one) else np.zeros(0)
        u, v, d = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([d, d])
        if k is not None:
            order = np.lexsort((w[v], d, u))
            u, v, d = u[order], v[order], d[order]
            first = np.arange(len(u)) - np.searchsorted(u, np.arange(len(c)))[u] < k
            u, v, d = u[first], v[first], d[first]
        return pa.record_batch([pa.array(w[u], pa.int64()), pa.array(w[v], pa.int64()), pa.array(d, pa.float64())], names=["u", "v", "d"])

    def run(batches):
        held = None  # the last neighbourhood of a batch may go on in the next one
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            c = np.asarray(rows.column(0).combine_chunks())
            whole = int(np.searchsorted(c, c[-1]))
            held = rows.slice(whole)
            if whole:
                yield joined(rows.slice(0, whole))
        if held is not None:
            yield joined(held)

    return dealt.mapInArrow(run, "u long, v long, d double")


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places below n; a neighbourhood has at most k + 2 * size members."""
    if n not in _TRIANGLES:
        _TRIANGLES[n] = np.triu_indices(n, 1)
    return _TRIANGLES[n]


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
