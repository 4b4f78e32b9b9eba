"""Registered queries of the graph engine over the table ``embeddings``, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.distance import METRICS, register_sql
from .functions.rand import derive, hash_one, sql_one, sql_two
from .operators.exact import exact_knn, exact_knn_expression, pair_distances
from .operators.graph import local_join, random_graph, reverse_edges, sample_reverse
from .operators.leaf import leaf_knn
from .operators.metrics import degree_stats, in_degrees, invariants, recall
from .operators.partition import assign_nearest, block_stats, recursive_partition, routed, sample_centroids, split_active
from .operators.topk import count_changes, merge_top_k
from .plans.descent import descent_knn, descent_round
from .plans.forest import epoch_lists, forest_knn
from .plans.history import History
from .plans.tables import settle, shared_path
from .sources.vectors import adjacency, from_table, ranked, read_adjacency_text, read_vectors_text, write_adjacency_text, write_vectors_text

K, RHO, ALPHA, SEED = 10, 5, 150, 42
SIZE = K // 2


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their label as the block."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("label").cast("string").alias("path"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _listed(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("u", "v", F.round("d", 5).alias("d"), *more)


def _ranked(edges: DataFrame) -> DataFrame:
    return ranked(edges).select("u", "v", F.col("rank").cast("long").alias("rank"), F.round("d", 5).alias("d"))


# SQL pieces. V has id and vec in doubles.
V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::VARCHAR AS label FROM embeddings)"
_SQL_D = {
    "l2": "list_distance({a}, {b})",
    "l1": "list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))",
    "cosine": "CASE WHEN list_sum(list_transform({a}, lambda t: t * t)) = 0 OR list_sum(list_transform({b}, lambda t: t * t)) = 0 THEN 1.0 ELSE 1 - list_cosine_similarity({a}, {b}) END",
}


def _d(a: str, b: str, metric: str = "l2") -> str:
    return _SQL_D[metric].format(a=a, b=b)


def _sql_exact(metric: str = "l2") -> str:
    return f"""exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, v) AS rank
  FROM (SELECT a.id AS u, b.id AS v, {_d('a.vec', 'b.vec', metric)} AS d FROM v a JOIN v b ON a.id <> b.id)) WHERE rank <= {K})"""


def _sql_sample(name: str, blocks: str, rho: int, seed: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT path, row_number() OVER (PARTITION BY path ORDER BY {sql_one('id', seed)}, id) - 1 AS idx, id, vec FROM {blocks}) WHERE idx < {rho})"


def _sql_partition(prefix: str, seed: int, levels: int = 7) -> str:
    """CTEs that split the root until no block is larger than ALPHA; the last is {prefix}{levels}."""
    out = [f"{prefix}0 AS (SELECT id, vec, '0' AS path FROM v)"]
    for n in range(levels):
        p = f"{prefix}{n}"
        out += [
            f"{p}s AS (SELECT path FROM {p} GROUP BY path HAVING count(*) > {ALPHA})",
            f"{p}m AS (SELECT * FROM {p} SEMI JOIN {p}s USING (path))",
            _sql_sample(f"{p}c", f"{p}m", RHO, derive(seed, n)),
            f"{p}a AS (SELECT * FROM (SELECT m.id, m.vec, m.path || '/' || c.idx AS path, row_number() OVER (PARTITION BY m.id ORDER BY {_d('m.vec', 'c.vec')}, c.idx) AS r FROM {p}m m JOIN {p}c c USING (path)) WHERE r = 1)",
            f"{prefix}{n + 1} AS (SELECT id, vec, path FROM {p} ANTI JOIN {p}s USING (path) UNION ALL SELECT id, vec, path FROM {p}a)",
        ]
    return ",\n".join(out)


def _sql_leaf(name: str, blocks: str, k: int = K) -> str:
    return f"""{name} AS (SELECT u, v, d FROM (SELECT *, row_number() OVER (PARTITION BY u, path ORDER BY d, v) AS r
  FROM (SELECT a.id AS u, b.id AS v, a.path, {_d('a.vec', 'b.vec')} AS d FROM {blocks} a JOIN {blocks} b ON a.path = b.path AND a.id <> b.id)) WHERE r <= {k})"""


def _sql_merge(name: str, old: str, new: str) -> str:
    return f"""{name} AS (SELECT u, v, d, is_new FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r
  FROM (SELECT u, v, min(d) AS d, bool_and(is_new) AS is_new
        FROM (SELECT u, v, d, false AS is_new FROM {old} UNION ALL SELECT u, v, d, true FROM {new}) GROUP BY u, v)) WHERE r <= {K})"""


def _sql_init(seed: int) -> str:
    draw = sql_two("a.id", "j", seed)
    return f"""dense AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index, count(*) OVER () AS n FROM v),
drawn AS (SELECT a.id AS u, b.id AS v, min(j) AS j FROM (SELECT a.id, j, ({draw}) % (SELECT count(*) FROM v) AS index FROM v a CROSS JOIN range(1, {2 * K + 17}) t(j)) a
  JOIN dense b USING (index) WHERE a.id <> b.id GROUP BY a.id, b.id),
g0 AS (SELECT u, w.v, {_d('x.vec', 'y.vec')} AS d, true AS is_new FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY j) AS r FROM drawn) w
  JOIN v x ON x.id = u JOIN v y ON y.id = w.v WHERE r <= {K})"""


def _sql_sampled(name: str, graph: str, seed: int) -> str:
    return f"{name} AS (SELECT c, w, is_new FROM (SELECT v AS c, u AS w, is_new, row_number() OVER (PARTITION BY v, is_new ORDER BY {sql_two('v', 'u', seed)}, u) AS r FROM {graph}) WHERE r <= {SIZE})"


def _sql_pairs(name: str, graph: str, seed: int) -> str:
    return f"""{_sql_sampled(name + 's', graph, seed)},
{name}b AS (SELECT u AS c, v AS w, is_new FROM {graph} UNION SELECT c, w, is_new FROM {name}s),
{name} AS (SELECT DISTINCT a.w AS x, b.w AS y FROM {name}b a JOIN {name}b b ON a.c = b.c AND a.w < b.w AND (a.is_new OR b.is_new))"""


def _sql_round(name: str, graph: str, seed: int) -> str:
    return f"""{_sql_pairs(name + 'p', graph, seed)},
{name}d AS (SELECT x, y, {_d('a.vec', 'b.vec')} AS d FROM {name}p JOIN v a ON a.id = x JOIN v b ON b.id = y),
{name}o AS (SELECT x AS u, y AS v, d FROM {name}d UNION ALL SELECT y, x, d FROM {name}d),
{_sql_merge(name, graph, name + 'o')}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_RANKED = "SELECT u, v, rank, round(d, 5) AS d FROM exact"


@_query(f"WITH {V}, {_sql_exact()} {_RANKED}")
def exact_knn_l2(spark, sf_dir):
    return _ranked(exact_knn(_vectors(spark, sf_dir), K, "l2"))


@_query(f"WITH {V}, {_sql_exact('l1')} {_RANKED}")
def exact_knn_l1(spark, sf_dir):
    return _ranked(exact_knn(_vectors(spark, sf_dir), K, "l1"))


@_query(f"WITH {V}, {_sql_exact('cosine')} {_RANKED}")
def exact_knn_cosine(spark, sf_dir):
    return _ranked(exact_knn(_vectors(spark, sf_dir), K, "cosine"))


def _centroid_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    blocks = _vectors(spark, sf_dir).select(F.lit("0").alias("path"), "id", "vec")
    return blocks, sample_centroids(blocks, RHO, SEED).join(blocks.select("id", "vec"), "id")


def _distance_query(name: str):
    def run(spark, sf_dir):
        blocks, centroids = _centroid_pairs(spark, sf_dir)
        sides = centroids.select("path", F.col("id").alias("centroid"), F.col("vec").alias("c"))
        return blocks.join(sides, "path").select("id", "centroid", F.round(METRICS[name].column(F.col("vec"), F.col("c")), 5).alias("d"))

    run.__name__ = f"distances_{name}"
    sql = f"WITH {V}, b AS (SELECT '0' AS path, id, vec FROM v), {_sql_sample('c', 'b', RHO, SEED)} SELECT b.id, c.id AS centroid, round({_d('b.vec', 'c.vec', name)}, 5) AS d FROM b JOIN c USING (path)"
    _query(sql)(run)


for _name in METRICS:
    _distance_query(_name)


@_query(f"WITH {V}, b AS (SELECT '0' AS path, id, vec FROM v), {_sql_sample('c', 'b', RHO, SEED)} SELECT b.id, c.id AS centroid, round({_d('b.vec', 'c.vec')}, 5) AS l2, round({_d('b.vec', 'c.vec', 'l1')}, 5) AS l1, round({_d('b.vec', 'c.vec', 'cosine')}, 5) AS cosine FROM b JOIN c USING (path)")
def distances_sql_functions(spark, sf_dir):
    register_sql(spark)
    blocks, centroids = _centroid_pairs(spark, sf_dir)
    blocks.join(centroids.select("path", F.col("id").alias("centroid"), F.col("vec").alias("c")), "path").createOrReplaceTempView("nearweave_pairs")
    return spark.sql("SELECT id, centroid, round(vector_l2(vec, c), 5) AS l2, round(vector_l1(vec, c), 5) AS l1, round(vector_cosine(vec, c), 5) AS cosine FROM nearweave_pairs")


@_query("SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_text_roundtrip(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    path = shared_path(spark, "text")
    write_vectors_text(vectors, path)
    dim = vectors.select(F.size("vec")).first()[0]
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return read_vectors_text(spark, path, dim).select("id", F.size("vec").cast("long").alias("dim"), F.round(total, 5).alias("total"))


_BLOCKS = "b AS (SELECT label AS path, id, vec FROM v)"


@_query(f"WITH {V}, {_BLOCKS}, {_sql_sample('c', 'b', RHO, SEED)} SELECT path, block_size, members FROM (SELECT path, count(*) AS block_size FROM b GROUP BY path) JOIN (SELECT path, string_agg(id::VARCHAR, ' ' ORDER BY idx) AS members FROM c GROUP BY path) USING (path)")
def block_stats_by_label(spark, sf_dir):
    return block_stats(_labelled(spark, sf_dir), RHO, SEED).select("path", "block_size", F.array_join("members", " ").alias("members"))


@_query(f"WITH {V}, {_BLOCKS}, {_sql_sample('c', 'b', RHO, SEED)} SELECT path, idx, id FROM c")
def sample_centroids_by_label(spark, sf_dir):
    return sample_centroids(_labelled(spark, sf_dir), RHO, SEED)


@_query(f"WITH {V}, s AS (SELECT label AS path, count(*) AS block_size FROM v GROUP BY label) SELECT path, block_size, block_size > 50 AS active FROM s")
def split_active_blocks(spark, sf_dir):
    sizes = _labelled(spark, sf_dir).groupBy("path").agg(F.count("*").alias("block_size"))
    active, final = split_active(sizes, 50)
    return active.withColumn("active", F.lit(True)).unionByName(final.withColumn("active", F.lit(False)))


@_query(f"WITH {V}, b AS (SELECT '0' AS path, id, vec FROM v), {_sql_sample('c', 'b', RHO, SEED)} SELECT id, idx, round(d, 5) AS d FROM (SELECT b.id, c.idx, {_d('b.vec', 'c.vec')} AS d, row_number() OVER (PARTITION BY b.id ORDER BY {_d('b.vec', 'c.vec')}, c.idx) AS r FROM b JOIN c USING (path)) WHERE r = 1")
def assign_nearest_centroid(spark, sf_dir):
    blocks, centroids = _centroid_pairs(spark, sf_dir)
    return assign_nearest(blocks, centroids).select("id", "idx", F.round("d", 5).alias("d"))


@_query(f"WITH {V}, {_sql_partition('p', SEED)} SELECT id, path FROM p7")
def partition_recursive(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return routed(vectors, recursive_partition(vectors, ALPHA, RHO, SEED), with_vectors=False).select("id", "path")


@_query(f"WITH {V}, {_BLOCKS}, {_sql_leaf('l', 'b')} SELECT u, v, round(d, 5) AS d FROM l")
def leaf_knn_by_label(spark, sf_dir):
    return _listed(leaf_knn(_labelled(spark, sf_dir), K))


_MERGED = f"WITH {V}, {_BLOCKS}, {_sql_leaf('l', 'b')}, {_sql_partition('p', SEED)}, {_sql_leaf('n', 'p7')}, {_sql_merge('m', 'l', 'n')}"


def _merged(spark, sf_dir) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    fresh = leaf_knn(routed(vectors, recursive_partition(vectors, ALPHA, RHO, SEED)), K)
    return merge_top_k(leaf_knn(_labelled(spark, sf_dir), K), fresh, K)


@_query(f"{_MERGED} SELECT u, v, round(d, 5) AS d, is_new FROM m")
def merge_neighbor_lists(spark, sf_dir):
    return _listed(_merged(spark, sf_dir), "is_new")


@_query(f"{_MERGED} SELECT count(*) FILTER (WHERE is_new) AS changes FROM m")
def change_count(spark, sf_dir):
    return spark.createDataFrame([(count_changes(_merged(spark, sf_dir)),)], "changes long")


@_query(f"WITH {V}, {_sql_exact()} {_RANKED}")
def forest_single_leaf(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _ranked(forest_knn(vectors, K, alpha=max(150_000, vectors.count()), rho=15, tau=0.01, seed=SEED, cutoff=None))


def _epoch(name: str, epoch: int) -> str:
    return f"{_sql_partition(name, derive(SEED, epoch, 0))}, {_sql_leaf(name + 'l', name + '7')}"


@_query(f"WITH {V}, {_epoch('p', 0)} SELECT u, v, round(d, 5) AS d FROM pl")
def forest_one_epoch(spark, sf_dir):
    return _listed(epoch_lists(_vectors(spark, sf_dir), K, ALPHA, RHO, SEED, 0))


_TWO = f"WITH {V}, {_epoch('p', 0)}, {_epoch('q', 1)}, {_sql_merge('m', 'pl', 'ql')}"


@_query(f"{_TWO} SELECT u, v, round(d, 5) AS d, is_new FROM m")
def forest_two_epochs(spark, sf_dir):
    return _listed(forest_knn(_vectors(spark, sf_dir), K, ALPHA, RHO, tau=0, seed=SEED, max_epochs=2), "is_new")


@_query(f"{_TWO}, {_sql_exact()} SELECT count(m.u) AS hits, count(*) AS total, round(count(m.u) / count(*), 5) AS recall FROM exact e LEFT JOIN m ON m.u = e.u AND m.v = e.v")
def recall_forest_vs_exact(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return recall(forest_knn(vectors, K, ALPHA, RHO, tau=0, seed=SEED, max_epochs=2), exact_knn(vectors, K))


_INIT = f"WITH {V}, {_sql_init(derive(SEED, 0))}"


def _init(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, sf_dir)
    return vectors, settle(random_graph(vectors, K, derive(SEED, 0)))


@_query(f"{_INIT} SELECT u, v, round(d, 5) AS d, is_new FROM g0")
def descent_init(spark, sf_dir):
    return _listed(_init(spark, sf_dir)[1], "is_new")


@_query(f"{_INIT} SELECT v AS c, u AS w, round(d, 5) AS d, is_new FROM g0")
def reverse_neighbors(spark, sf_dir):
    return reverse_edges(_init(spark, sf_dir)[1]).withColumn("d", F.round("d", 5))


@_query(f"{_INIT}, {_sql_sampled('s', 'g0', derive(SEED, 1))} SELECT c, w, is_new FROM s")
def reverse_sample(spark, sf_dir):
    return sample_reverse(_init(spark, sf_dir)[1], SIZE, derive(SEED, 1))


@_query(f"{_INIT}, {_sql_pairs('p', 'g0', derive(SEED, 1))} SELECT x, y FROM p")
def local_join_pairs(spark, sf_dir):
    return local_join(_init(spark, sf_dir)[1], SIZE, derive(SEED, 1))


@_query(f"{_INIT}, {_sql_pairs('p', 'g0', derive(SEED, 1))} SELECT x AS u, y AS v, round({_d('a.vec', 'b.vec', 'cosine')}, 5) AS d FROM p JOIN v a ON a.id = x JOIN v b ON b.id = y")
def pair_distances_cosine(spark, sf_dir):
    vectors, graph = _init(spark, sf_dir)
    pairs = local_join(graph, SIZE, derive(SEED, 1)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    return _listed(pair_distances(pairs, vectors, "cosine"))


_ROUND1 = f"{_INIT}, {_sql_round('g1', 'g0', derive(SEED, 1))}"


@_query(f"{_ROUND1} SELECT u, v, round(d, 5) AS d, is_new FROM g1")
def descent_round1(spark, sf_dir):
    vectors, graph = _init(spark, sf_dir)
    return _listed(descent_round(graph, vectors, K, SIZE, derive(SEED, 1)), "is_new")


@_query(f"{_ROUND1}, {_sql_round('g2', 'g1', derive(SEED, 2))} SELECT u, v, round(d, 5) AS d, is_new FROM g2")
def descent_round2(spark, sf_dir):
    return _listed(descent_knn(_vectors(spark, sf_dir), K, sample=0.5, et=0, seed=SEED, max_rounds=2), "is_new")


@_query(f"WITH {V}, {_sql_exact()} SELECT u, string_agg(v::VARCHAR, ' ' ORDER BY rank) AS neighbors FROM exact GROUP BY u")
def adjacency_list(spark, sf_dir):
    return adjacency(exact_knn(_vectors(spark, sf_dir), K))


@_query(f"WITH {V}, {_sql_exact()} SELECT u, v, rank FROM exact")
def adjacency_text_roundtrip(spark, sf_dir):
    path = shared_path(spark, "graph")
    write_adjacency_text(exact_knn(_vectors(spark, sf_dir), K), path)
    return read_adjacency_text(spark, path).select("u", "v", F.col("rank").cast("long").alias("rank"))


@_query(f"{_TWO} SELECT count(*) AS nodes, sum(degree)::BIGINT AS edges, min(degree) AS min_degree, max(degree) AS max_degree FROM (SELECT v.id, count(m.u) AS degree FROM v LEFT JOIN m ON m.u = v.id GROUP BY v.id)")
def graph_degree_stats(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return degree_stats(forest_knn(vectors, K, ALPHA, RHO, tau=0, seed=SEED, max_epochs=2), vectors)


@_query(f"WITH {V}, {_sql_exact()} SELECT v, count(*) AS in_degree FROM exact GROUP BY v")
def graph_in_degrees(spark, sf_dir):
    return in_degrees(exact_knn(_vectors(spark, sf_dir), K))


def _sound(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """The invariants with the full degree, 0 loops, duplicates and unknown ends, and true distances and order."""
    true = pair_distances(edges.select("u", "v", F.col("d").alias("told")), vectors)
    off = true.agg(F.coalesce(F.sum((F.abs(F.col("d") - F.col("told")) > 1e-9).cast("long")), F.lit(0)).alias("untrue")).withColumn("_k", F.lit(1))
    return invariants(edges, vectors).withColumn("_k", F.lit(1)).join(off, "_k").drop("_k")


_SOUND = f"SELECT count(*) AS nodes, count(*) * {K} AS edges, {K}::BIGINT AS min_degree, {K}::BIGINT AS max_degree, 0::BIGINT AS self_loops, 0::BIGINT AS duplicates, 0::BIGINT AS unknown, 0::BIGINT AS untrue FROM embeddings"


@_query(_SOUND)
def forest_converged_invariants(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _sound(forest_knn(vectors, K, ALPHA, RHO, tau=0.01, seed=SEED, trees=6), vectors)


@_query(_SOUND)
def descent_converged_invariants(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _sound(descent_knn(vectors, K, sample=0.5, et=0.001, seed=SEED), vectors)


@_query(_SOUND)
def local_descent_invariants(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _sound(leaf_knn(vectors.select(F.lit("0").alias("path"), "id", "vec"), K, cutoff=100, seed=SEED), vectors)


def _sql_levels(prefix: str, epoch: int, levels: int = 7) -> str:
    """A row for each level of a partition, up to the first without blocks to split."""
    rows = [f"SELECT 'partition' AS phase, {epoch} AS epoch, {n} AS iter, (SELECT count(*) FROM {prefix}{n}m) AS rows, (SELECT count(*) FROM {prefix}{n}s) AS changes" for n in range(levels)]
    return " UNION ALL ".join(row + (f" WHERE EXISTS (SELECT * FROM {prefix}{n - 1}s)" if n else "") for n, row in enumerate(rows))


@_query(f"WITH {V}, {_epoch('p', 0)} {_sql_levels('p', 0)} UNION ALL SELECT 'forest', 0, 0, count(*), count(*) FROM pl")
def build_history(spark, sf_dir):
    history = History()
    forest_knn(_vectors(spark, sf_dir), K, alpha=ALPHA, rho=RHO, max_epochs=1, seed=SEED, history=history)
    return history.frame(spark).select("phase", "epoch", "iter", "rows", "changes")


@_query(f"WITH {V}, {_sql_exact()} {_RANKED}")
def exact_knn_by_expressions(spark, sf_dir):
    return _ranked(exact_knn_expression(_vectors(spark, sf_dir).repartition(8), K, "l2"))
