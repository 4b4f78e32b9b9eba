"""Recursive random partitioning around sampled members.

Only the tree of centroids grows, level by level; vectors are never rewritten. A level is one scan: each vector is routed
through the tree so far, and what is shuffled are block sizes and the few members with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, metric
from ..functions.rand import PRIME, derive, hash_one
from .leaf import edge_batch, matrix

ROOT = "0"
#: Bytes of centroids that are sent to every executor, at most.
TREE_BYTES = 512 << 20
#: Ids of sampled members, or paths of blocks, that are sent to every executor, at most.
SENT_IDS = 1_000_000
#: Vectors of a block whose part of a tree is grown, and whose leaves are solved, in one task, and their bytes in doubles, at most.
WHOLE, WHOLE_BYTES = 131_072, 64 << 20


def block_stats(blocks: DataFrame, rho: int, seed: int) -> DataFrame:
    """path, block_size and members (the ids of the sample, in order of their hashes)."""
    sizes = blocks.groupBy("path").agg(F.count("*").alias("block_size"))
    chosen = sample_centroids(blocks, rho, seed).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "id"))).alias("s"))
    return sizes.join(chosen, "path").select("path", "block_size", F.transform("s", lambda x: x["id"]).alias("members"))


def sample_centroids(blocks: DataFrame, rho: int, seed: int) -> DataFrame:
    """path, idx (from 0), id: rho members of every block, a uniform sample by hash; all of them where there are fewer.

    Spark cuts each partition's rows to rho a block before the shuffle.
    """
    order = Window.partitionBy("path").orderBy(hash_one(F.col("id"), seed), "id")
    return blocks.select("path", "id").withColumn("idx", (F.row_number().over(order) - 1).cast("long")).filter(F.col("idx") < rho).select("path", "idx", "id")


def split_active(sizes: DataFrame, alpha: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that must be split again, and final ones (columns path, block_size)."""
    return sizes.filter(F.col("block_size") > alpha), sizes.filter(F.col("block_size") <= alpha)


def _np_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ((ids % PRIME) * 1103515245 + (seed * 12345 + 1013904223)) % PRIME
    return (x * x % PRIME) * 48271 % PRIME


class Tree:
    """Centroids of split blocks by path; a block whose members no centroid tells apart is split by hash."""

    def __init__(self, m: Metric, rho: int, seed: int):
        self.m, self.rho, self.seed = m, rho, seed
        self.centroids: dict[str, np.ndarray | None] = {}
        self.sizes: dict[str, int] = {}

    def bytes(self) -> int:
        return sum(c.nbytes for c in self.centroids.values() if c is not None)

    def route(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The path of each vector."""
        paths = np.full(len(ids), ROOT, object)
        todo = [(ROOT, np.arange(len(ids)))] if ROOT in self.centroids and len(ids) else []
        while todo:
            path, rows = todo.pop()
            c = self.centroids[path]
            if c is None:
                branch = _np_hash(ids[rows], derive(self.seed, 77, path.count("/"))) % self.rho
            else:
                near = np.stack([self.m.rows(x[rows], c[i][None, :]) for i in range(len(c))], 1)
                branch = near.argmin(1)  # the first centroid wins ties
            for i in np.unique(branch):
                mine, own = rows[branch == i], f"{path}/{i}"
                paths[mine] = own
                if own in self.centroids:
                    todo.append((own, mine))
        return paths


def routed(vectors: DataFrame, tree: Tree, with_vectors: bool = True) -> DataFrame:
    """path, id and vec of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast(tree)
    kind = "path string, id long" + ", vec array<float>" * with_vectors

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            paths = held.value.route(ids, matrix(batch.column("vec"), batch.num_rows)) if batch.num_rows else []
            cols = [pa.array(list(paths), pa.string()), batch.column("id")] + [batch.column("vec")] * with_vectors
            yield pa.record_batch(cols, names=["path", "id", "vec"][: len(cols)])

    return vectors.select("id", "vec").mapInArrow(run, kind)


def _placed(vectors: DataFrame, trees: list[Tree], level: int) -> DataFrame:
    """tree, path, id and the id's hash on that level, of every vector in each of the trees."""
    held = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            ids, x = np.asarray(batch.column("id")), matrix(batch.column("vec"), batch.num_rows) if batch.num_rows else None
            for i, tree in enumerate(held.value if batch.num_rows else ()):
                cols = [pa.array(np.full(len(ids), i, np.int32)), pa.array(list(tree.route(ids, x)), pa.string()), batch.column("id"), pa.array(_np_hash(ids, derive(tree.seed, level)))]
                yield pa.record_batch(cols, names=["tree", "path", "id", "h"])

    return vectors.select("id", "vec").mapInArrow(run, "tree int, path string, id long, h long")


def grow_level(vectors: DataFrame, trees: list[Tree], alpha: int, level: int) -> list[dict[str, int]]:
    """Split every block that is larger than alpha, in all trees at once; for each tree the sizes of those blocks."""
    spark, rho = vectors.sparkSession, trees[0].rho
    placed = _placed(vectors, trees, level)
    sizes: list[dict[str, int]] = [{} for _ in trees]
    for r in placed.groupBy("tree", "path").count().filter(F.col("count") > alpha).collect():
        sizes[r.tree][r.path] = r["count"]
    blocks = [(i, path) for i, own in enumerate(sizes) for path in own]
    if not blocks:
        return sizes
    # Fewer than N / alpha blocks with rho centroids each: a tree's bytes are checked before any centroid is fetched.
    width = vectors.select(F.size("vec").alias("w")).first().w
    if sum(tree.bytes() for tree in trees) + 8 * rho * len(blocks) * width > TREE_BYTES:
        raise ValueError("the tree of centroids is larger than may be sent to every executor: raise alpha or lower rho")
    active = spark.createDataFrame(blocks, "tree int, path string")
    if len(blocks) <= SENT_IDS:
        active = F.broadcast(active)
    order = Window.partitionBy("tree", "path").orderBy("h", "id")
    chosen = placed.join(active, ["tree", "path"], "left_semi").withColumn("idx", F.row_number().over(order) - 1).filter(F.col("idx") < rho).drop("h")
    if rho * len(blocks) <= SENT_IDS:
        chosen = F.broadcast(chosen)  # so few ids that vectors needn't be shuffled to meet them
    rows = vectors.select("id", "vec").join(chosen, "id").select("tree", "path", "idx", "vec").collect()
    found: dict[tuple[int, str], list] = {}
    for r in sorted(rows, key=lambda r: (r.tree, r.path, r.idx)):
        found.setdefault((r.tree, r.path), []).append(r.vec)
    for (i, path), centres in found.items():
        c = np.array(centres, np.float64)
        trees[i].centroids[path] = None if (c == c[0]).all() else c
    for tree, own in zip(trees, sizes):
        for path, size in own.items():  # a block that holds all its parent's members was not split: go on by hash
            if tree.sizes.get(path.rsplit("/", 1)[0]) == size and path != ROOT:
                tree.centroids[path] = None
        tree.sizes.update(own)
    return sizes


def recursive_partition(vectors: DataFrame, alpha: int, rho: int, seed: int = 0, metric_name: str | Metric = "l2", max_depth: int = 64, report: Callable[[int, dict[str, int]], None] | None = None) -> Tree:
    """A tree whose leaves hold at most alpha vectors each (unless max_depth ends it); report gets each level's split blocks."""
    return partition_forest(vectors, alpha, rho, [seed], metric_name, max_depth, report)[0]


def partition_forest(vectors: DataFrame, alpha: int, rho: int, seeds: list[int], metric_name: str | Metric = "l2", max_depth: int = 64, report: Callable[[int, dict[str, int]], None] | None = None) -> list[Tree]:
    """A tree for each seed; a level of all of them is two jobs, however many they are."""
    trees = [Tree(metric(metric_name), rho, seed) for seed in seeds]
    growing = trees
    for level in range(max_depth if trees else 0):
        grown = grow_level(vectors, growing, alpha, level)
        for sizes in grown if report is not None else ():
            report(level, sizes)
        growing = [tree for tree, sizes in zip(growing, grown) if sizes]
        if not growing:
            break
    return trees


def forest_routed(vectors: DataFrame, trees: list[Tree]) -> DataFrame:
    """path, id and vec of every vector in each of several trees; a path begins with its tree's seed."""
    held = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            ids, x = np.asarray(batch.column("id")), matrix(batch.column("vec"), batch.num_rows) if batch.num_rows else None
            for tree in held.value if batch.num_rows else ():
                paths = [f"{tree.seed}:{path}" for path in tree.route(ids, x)]
                yield pa.record_batch([pa.array(paths, pa.string()), batch.column("id"), batch.column("vec")], names=["path", "id", "vec"])

    return vectors.select("id", "vec").mapInArrow(run, "path string, id long, vec array<float>")


def _divided(ids: np.ndarray, x: np.ndarray, path: str, above: int, grown: Tree, alpha: int, max_depth: int = 64) -> Iterator[tuple[str, np.ndarray]]:
    """Paths and rows of the leaves that grow_level would split one block into, level by level; above: its parent's size."""
    todo = [(path, np.arange(len(ids)), above)]
    while todo:
        path, rows, above = todo.pop()
        level = path.count("/")
        if len(rows) <= alpha or level >= max_depth:
            yield path, rows
            continue
        h = _np_hash(ids[rows], derive(grown.seed, level))
        chosen = rows[np.lexsort((ids[rows], h))[: grown.rho]]
        c = x[chosen]
        if len(rows) == above or (c == c[0]).all():
            branch = _np_hash(ids[rows], derive(grown.seed, 77, level)) % grown.rho
        else:
            own = x[rows]
            branch = np.stack([grown.m.rows(own, y[None, :]) for y in c], 1).argmin(1)
        todo += [(f"{path}/{i}", rows[branch == i], len(rows)) for i in np.unique(branch)]


def apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that dealing by them to n partitions puts in one each."""
    first = spark.range(100 + 20 * n * n.bit_length()).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("x"))
    return [r.x for r in first.orderBy("p").collect()]


def grown_leaves(vectors: DataFrame, alpha: int, rho: int, seeds: list[int], solve: Callable[[str, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], metric_name: str | Metric = "l2", n: int | None = None) -> DataFrame:
    """u, v, d of the leaves of a tree for each seed, as partition_forest and a solver for each leaf give them.

    Trees grow level by level only down to blocks of WHOLE vectors; the task that gets such a block grows what is below it
    and solves its leaves. n: how many vectors there are, if that is known.
    """
    width = vectors.select(F.size("vec").alias("w")).first()
    whole = max(alpha, min(WHOLE, WHOLE_BYTES // (8 * max(1, width.w if width else 1))))
    single = n is not None and n <= whole
    trees = [Tree(metric(metric_name), rho, seed) for seed in seeds] if single else partition_forest(vectors, whole, rho, seeds, metric_name)
    held = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(block: pa.Table) -> pa.Table:
        seed, path = block.column("path")[0].as_py().split(":")
        tree = next(t for t in held.value if t.seed == int(seed))
        ids, x = np.asarray(block.column("id")), matrix(block.column("vec"), block.num_rows)
        above = tree.sizes.get(path.rsplit("/", 1)[0], -1) if path != ROOT else -1
        name = lambda own: own if len(seeds) == 1 else f"{seed}:{own}"
        parts = [solve(name(own), ids[rows], x[rows]) for own, rows in _divided(ids, x, path, above, tree, alpha)]
        return edge_batch(*(np.concatenate(z) for z in zip(*parts)))

    blocks, keys = forest_routed(vectors, trees), ["path"]
    if single:  # few blocks, so each goes to a task of its own
        slots = apart(vectors.sparkSession, len(seeds))
        which = F.array_position(F.array(*[F.lit(f"{seed}:{ROOT}") for seed in seeds]), F.col("path")).cast("int")
        blocks, keys = blocks.withColumn("slot", F.element_at(F.array(*[F.lit(x) for x in slots]), which)).repartition(len(seeds), "slot"), ["slot", "path"]
    return blocks.groupBy(*keys).applyInArrow(run, "u long, v long, d double")


def assign_nearest(vectors: DataFrame, centroids: DataFrame, metric_name: str | Metric = "l2") -> DataFrame:
    """id, idx, d: each vector's nearest centroid of its own block (columns path, id, vec and path, idx, vec).

    Centroids are few for each block; the block's centroids travel with a join on the block, ties go to the lower idx.
    """
    m = metric(metric_name)
    sides = centroids.select("path", "idx", F.col("vec").alias("c"))
    all_d = vectors.join(sides, "path").select("id", "idx", m.column(F.col("vec"), F.col("c")).alias("d"))
    best = all_d.groupBy("id").agg(F.min(F.struct("d", "idx")).alias("s"))
    return best.select("id", "s.idx", "s.d")
