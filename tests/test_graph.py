"""Edge cases of the graph engine: small inputs, duplicates, outliers, sparse ids, ties, bad lines, kernels."""

import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearweave import __main__ as command_line
from nearweave.functions.distance import METRICS, Metric, metric
from nearweave.operators import graph as graph_steps
from nearweave.operators import exact, leaf, partition
from nearweave.operators.exact import exact_knn, exact_knn_expression
from nearweave.operators.graph import dense_index, local_join, offers, random_graph, random_neighbors
from nearweave.operators.leaf import brute_force, local_descent, solve_block
from nearweave.operators.metrics import degree_stats, invariants, recall
from nearweave.operators.partition import recursive_partition, routed
from nearweave.operators.topk import merge_top_k
from nearweave.plans.history import History
from nearweave.plans.descent import descent_knn
from nearweave.plans.engine import KnnGraph
from nearweave.plans.forest import forest_knn
from nearweave.plans import tables
from nearweave.plans.tables import shared_root
from nearweave.queries import QUERIES
from nearweave.sources.vectors import read_adjacency_text, read_vectors_text


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "id long, vec array<float>")


def edges(df):
    return {(r.u, r.v): r.d for r in df.collect()}


def truth(vectors, ids, k, name="l2"):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for i in range(len(x)):
        d = METRICS[name].rows(np.repeat(x[i : i + 1], len(x), 0), x)
        near = sorted((d[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out |= {(ids[i], j): dist for dist, j in near}
    return out


RNG = np.random.default_rng(3)


@pytest.mark.parametrize("name", list(METRICS))
@pytest.mark.parametrize("block", [7, 4096])
def test_exact_in_blocks_of_any_size(spark, name, block):
    x = RNG.normal(size=(40, 6))
    ids = [5, 1000, 7_000_000, *range(2000, 2037)]
    got, want = edges(exact_knn(frame(spark, x, ids), 4, name, block=block)), truth(x, ids, 4, name)
    assert got.keys() == want.keys()
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_expressions_agree_with_kernels(spark):
    v = frame(spark, RNG.normal(size=(30, 5)))
    for name in METRICS:
        a, b = edges(exact_knn(v, 3, name)), edges(exact_knn_expression(v, 3, name))
        assert a.keys() == b.keys() and all(abs(a[e] - b[e]) < 1e-9 for e in a)


def test_few_vectors_clamp_k(spark):
    v = frame(spark, RNG.normal(size=(4, 5)))
    for build in (forest_knn, descent_knn):
        for k in (2, 10):
            got = build(v, k).groupBy("u").count().collect()
            assert len(got) == 4 and {r["count"] for r in got} == {min(k, 3)}
    one = frame(spark, [[1.0, 2.0]])
    assert forest_knn(one, 3).count() == 0 and descent_knn(one, 3).count() == 0
    assert exact_knn(one, 3).count() == 0


def test_full_leaf_is_exact_and_ends(spark):
    x = RNG.normal(size=(30, 5))
    g = KnnGraph(frame(spark, x), k=5)
    got = edges(g.forest(alpha=30, rho=3))
    assert got.keys() == truth(x, range(30), 5).keys()
    done = g.progress()
    assert [(r.epoch, r.changes) for r in done.filter("phase = 'forest'").orderBy("epoch").collect()] == [(0, 150), (1, 0)]
    assert [(r.epoch, r.iter, r.rows) for r in done.filter("phase = 'partition'").orderBy("epoch").collect()] == [(0, 0, 0), (1, 0, 0)]
    assert g.recall(exact_knn(g.vectors, 5)).first().recall == 1.0


def test_duplicates_end_the_partition(spark):
    x = [[1.0, 1.0]] * 50 + [list(r) for r in RNG.normal(size=(10, 2))]
    v = frame(spark, x)
    tree = recursive_partition(v, 20, 4, seed=1)
    sizes = [r["count"] for r in routed(v, tree, False).groupBy("path").count().collect()]
    assert sum(sizes) == 60 and max(sizes) <= 20


def test_outlier_stays_a_node(spark):
    x = np.concatenate([RNG.normal(size=(40, 3)) * 0.01, [[100.0, 100.0, 100.0]]])
    v = frame(spark, x)
    got = forest_knn(v, 3, alpha=10, rho=3, tau=0, max_epochs=2)
    assert degree_stats(got, v).first().nodes == 41


def test_zero_vectors_are_one_away_by_cosine(spark):
    got = edges(exact_knn(frame(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]), 2, "cosine"))
    assert got[0, 1] == got[0, 2] == 1.0


def test_ties_go_to_smaller_ids(spark):
    grid = [[i, j] for i in range(5) for j in range(5)]
    assert edges(exact_knn(frame(spark, grid), 4)).keys() == truth(grid, range(25), 4).keys()


def test_random_graph_tells_true_distances(spark):
    x = RNG.normal(size=(200, 4))
    ids = [3 * i + 7 for i in range(200)]
    v = frame(spark, x, ids)
    got = edges(random_graph(v, 5, 9))
    x32 = x.astype(np.float32).astype(np.float64)
    assert len(got) == 1000 and all(u != w for u, w in got)
    assert all(abs(d - np.linalg.norm(x32[(u - 7) // 3] - x32[(w - 7) // 3])) < 1e-9 for (u, w), d in got.items())
    index, n = dense_index(v.select("id"))
    assert n == 200 and sorted((r["id"], r["index"]) for r in index.collect()) == [(i, j) for j, i in enumerate(ids)]


def test_same_seed_same_graph_for_any_partitions(spark):
    v = frame(spark, RNG.normal(size=(150, 4)))
    build = lambda p, f, **o: edges(f(v.repartition(p), 4, seed=5, **o))
    for f, o in ((forest_knn, {"alpha": 30, "rho": 3, "tau": 0, "max_epochs": 2}), (descent_knn, {"max_rounds": 2})):
        assert build(1, f, **o) == build(4, f, **o) == build(9, f, **o)


def test_descent_lists_never_get_worse(spark):
    v = frame(spark, RNG.normal(size=(200, 6)))
    totals = [sum(edges(descent_knn(v, 5, et=0, max_rounds=r)).values()) for r in (1, 2, 4)]
    assert totals[0] >= totals[1] >= totals[2]
    good = invariants(descent_knn(v, 5, max_rounds=3), v).first()
    assert (good.min_degree, good.max_degree, good.self_loops, good.duplicates, good.unknown) == (5, 5, 0, 0, 0)


def test_forest_reaches_high_recall(spark):
    v = frame(spark, RNG.normal(size=(400, 8)))
    got = forest_knn(v, 5, alpha=80, rho=4, tau=0.01, trees=8)
    assert recall(got, exact_knn(v, 5)).first().recall >= 0.9


def test_old_entries_win_and_new_ones_count(spark):
    old = spark.createDataFrame([(1, 2, 0.5, True), (1, 3, 0.7, False)], "u long, v long, d double, is_new boolean")
    new = spark.createDataFrame([(1, 2, 0.5), (1, 4, 0.6), (1, 4, 0.6)], "u long, v long, d double")
    assert sorted((r.v, r.is_new) for r in merge_top_k(old, new, 2).collect()) == [(2, False), (4, True)]


def test_text_lines(spark, tmp_path):
    (tmp_path / "good.txt").write_text("0 1.5  2.5 9\n\n7\t-1e3 0.25\n")
    assert sorted((r.id, list(r.vec)) for r in read_vectors_text(spark, str(tmp_path / "good.txt"), 2).collect()) == [(0, [1.5, 2.5]), (7, [-1000.0, 0.25])]
    for name, line in (("short", "1 2.0"), ("word", "1 2.0 x"), ("id", "x 1.0 2.0")):
        (tmp_path / f"{name}.txt").write_text(line + "\n")
        with pytest.raises(Exception):
            read_vectors_text(spark, str(tmp_path / f"{name}.txt"), 2).collect()


def test_adjacency_text_keeps_order(spark, tmp_path):
    g = KnnGraph(frame(spark, RNG.normal(size=(20, 3))), k=3)
    exact = truth(np.array([r.vec for r in g.vectors.orderBy("id").collect()]), range(20), 3)
    g.exact()
    g.write_text(str(tmp_path / "g"))
    g.write(str(tmp_path / "e"))
    got = {}
    for r in read_adjacency_text(spark, str(tmp_path / "g")).orderBy("u", "rank").collect():
        got.setdefault(r.u, []).append(r.v)
    assert all(got[u] == [v for (a, v), _ in sorted(exact.items(), key=lambda e: (e[0][0], e[1], e[0][1])) if a == u] for u in range(20))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 60


def test_command_line(spark, tmp_path):
    lines = "\n".join(f"{i} " + " ".join(map(str, v)) for i, v in enumerate(RNG.normal(size=(40, 3)).round(3).tolist()))
    (tmp_path / "in.txt").write_text(lines)
    for words in (["forest", "--alpha", "20", "--rho", "3", "--tau", "0.5"], ["descent", "--sample", "1", "--et", "0.1"], ["exact", "--metric", "l1"]):
        out = str(tmp_path / words[0])
        command_line.build(spark, command_line.arguments([*words, "--input", str(tmp_path / "in.txt"), "--dim", "3", "--k", "4", "--output", out]))
        assert read_adjacency_text(spark, out).groupBy("u").count().filter("count = 4").count() == 40
    assert command_line.arguments(["forest", "--input", "x"]).alpha == 150_000


def test_user_metrics(spark):
    chebyshev = Metric("max", lambda a, b: None, lambda a, b: np.abs(a - b).max(-1), lambda a, b: np.abs(a[:, None] - b[None]).max(-1))
    got = edges(exact_knn(frame(spark, [[0, 0], [3, 1], [2, 2]]), 1, chebyshev))
    assert got == {(0, 2): 2.0, (1, 2): 1.0, (2, 1): 1.0}
    with pytest.raises(ValueError):
        metric("other")


def test_local_descent_recall():
    x = np.random.default_rng(1).normal(size=(1500, 8))
    m = METRICS["l2"]
    near, d = local_descent(x, 10, m, seed=4, leaf=200)
    u, v, _ = brute_force(x, x, np.arange(1500), np.arange(1500), 10, m)
    exact = set(zip(u.tolist(), v.tolist()))
    found = {(i, int(j)) for i in range(1500) for j in near[i]}
    assert len(exact & found) / len(exact) > 0.9
    assert (np.diff(d, axis=1) >= 0).all()


def test_local_descent_in_small_tiles_finds_the_same(monkeypatch):
    x = np.random.default_rng(2).normal(size=(600, 6))
    whole = local_descent(x, 8, METRICS["l2"], seed=1, leaf=100)
    monkeypatch.setattr(leaf, "GATHERED", 1 << 16)
    monkeypatch.setattr(leaf, "TILE_BYTES", 1 << 12)
    tiles = local_descent(x, 8, METRICS["l2"], seed=1, leaf=100)
    assert (whole[0] == tiles[0]).mean() > 0.95 and (whole[1][:, -1] > 0).all()


def test_offers_cut_to_k_change_no_round(spark):
    vectors = frame(spark, RNG.normal(size=(150, 4)))
    graph = random_graph(vectors, 6, 3).cache()
    whole, cut = (edges(merge_top_k(graph, offers(graph, vectors, 3, 5, "l2", k), 6)) for k in (None, 6))
    assert whole == cut
    pairs = {(r.x, r.y) for r in local_join(graph, 3, 5).collect()}
    assert {(r.u, r.v) for r in offers(graph, vectors, 3, 5).collect()} == pairs | {(y, x) for x, y in pairs}


def test_short_random_lists_are_filled(spark, monkeypatch):
    ids = spark.range(200).withColumn("id", F.col("id") * 3)
    monkeypatch.setattr(graph_steps, "hash_two", lambda u, v, seed: F.lit(7).cast("long"))
    rows = random_neighbors(ids, 5, 1).collect()
    found = {}
    for r in rows:
        found.setdefault(r.u, set()).add(r.v)
    assert len(rows) == 1000 and all(len(v) == 5 and u not in v for u, v in found.items())


def test_partition_with_many_active_blocks(spark):
    x = np.concatenate([np.arange(4500.0) * 10, np.arange(4500.0) * 10 + 0.1])
    vectors = frame(spark, x[:, None]).coalesce(4)
    seen = []
    tree = recursive_partition(vectors, 2, 1200, seed=2, report=lambda level, sizes: seen.append(sizes))
    sizes = [r["count"] for r in routed(vectors, tree).groupBy("path").count().collect()]
    assert max(sizes) <= 2 and sum(sizes) == 9000
    assert len(seen[1]) >= 1000 and seen[-1] == {}
    final = set(seen[0]) | set(seen[1])
    assert set(tree.centroids) == set().union(*seen) and final <= set(tree.centroids)


def test_partition_is_the_same_without_broadcasts(spark, monkeypatch):
    vectors = frame(spark, RNG.normal(size=(120, 3)))
    paths = lambda: {(r.id, r.path) for r in routed(vectors, recursive_partition(vectors, 20, 4, seed=1)).collect()}
    sent = paths()
    monkeypatch.setattr(partition, "SENT_IDS", 0)
    assert paths() == sent


def test_too_large_a_tree_is_refused_before_it_is_fetched(spark, monkeypatch):
    monkeypatch.setattr(partition, "TREE_BYTES", 100)
    with pytest.raises(ValueError):
        recursive_partition(frame(spark, RNG.normal(size=(50, 4))), 10, 5)


def test_builds_leave_nothing_but_what_their_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_root", lambda spark: str(tmp_path))
    vectors = frame(spark, RNG.normal(size=(300, 3)))
    for build in (lambda: forest_knn(vectors, 4, alpha=60, rho=3, max_epochs=2), lambda: descent_knn(vectors, 4, max_rounds=2)):
        out = build()
        assert out.count() and {f.rpartition("/")[0].removeprefix("file:").replace("///", "/") for f in out.inputFiles()} == {str(p) for p in tmp_path.iterdir()}
        shutil.rmtree(next(tmp_path.iterdir()))


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(ValueError):
        shared_root(Unset)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 30), st.integers(1, 8), st.integers(0, 10_000))
def test_block_solver_matches_brute_force(n, k, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 4, (n, 2)).astype(np.float64)
    ids = r.permutation(1000)[:n]
    u, v, d = solve_block(ids, x, k, METRICS["l2"], 100, 0)
    assert dict(zip(zip(u.tolist(), v.tolist()), d.tolist())).keys() == truth(x, ids.tolist(), k).keys()


def test_single_leaf_is_exact_at_any_size(spark, tmp_path):
    x = RNG.normal(size=(leaf.CUTOFF + 100, 24)).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 24).cast(pa.list_(pa.float32()))})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    got, want = (QUERIES[name](spark, str(tmp_path)) for name in ("forest_single_leaf", "exact_knn_l2"))
    assert got.count() == 10 * len(x) and got.exceptAll(want).isEmpty()


def test_exact_leaves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_BYTES", 200)
    x = RNG.normal(size=(40, 4))
    v = frame(spark, x)
    whole = forest_knn(v, 3, alpha=40, rho=3, cutoff=None)
    assert edges(whole).keys() == truth(x, range(40), 3).keys()
    parts = [forest_knn(v, 3, alpha=12, rho=3, tau=0, max_epochs=2, cutoff=c).select("u", "v") for c in (None, 100)]
    assert set(parts[0].collect()) == set(parts[1].collect())


def test_l1_table_in_single_precision_loses_no_neighbour():
    x = np.ones((300, 5), np.float32)
    x[:, 0] += np.random.default_rng(5).permutation(300).astype(np.float32) * np.float32(2**-23)  # neighbours one rounding apart
    x[:, 1] = np.linspace(0, 1e-6, 300, dtype=np.float32)
    x, ids = x.astype(np.float64), np.arange(300)
    table = METRICS["l1"].table(x, x)
    assert table.dtype == np.float32 and METRICS["l1"].table(x + 1e-12, x).dtype == np.float64
    assert np.allclose(table, np.abs(x[:, None] - x[None]).sum(-1), rtol=1e-6, atol=0)
    u, v, _ = brute_force(x, x, ids, ids, 4, METRICS["l1"])
    assert set(zip(u.tolist(), v.tolist())) == truth(x, range(300), 4, "l1").keys()


@pytest.mark.parametrize("part", [1, 3])
def test_expressions_judge_few_pairs_and_lose_none(spark, monkeypatch, part):
    x = np.random.default_rng(part).normal(size=(200, 7)) * 10.0 ** (part - 2) + part
    x[5], x[6] = x[7], x[7]
    v = frame(spark, x)
    pairs = exact._near_pairs(v, 3)
    assert pairs.count() < 200 * 199 // 4
    assert edges(exact_knn_expression(v, 3)).keys() == truth(x, range(200), 3).keys()
    monkeypatch.setattr(exact, "SENT_BYTES", 0)
    few = frame(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    assert edges(exact_knn_expression(few, 5)).keys() == truth([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]], range(3), 5).keys()
    assert exact_knn_expression(frame(spark, [[1.0, 1.0]] * 4), 2).count() == 8
    assert exact._near_pairs(frame(spark, [[1.0, float("inf")]] * 4), 2) is None and exact._near_pairs(v.limit(0), 2) is None


def test_trees_of_an_epoch_grow_together(spark, monkeypatch):
    v, seeds, grow, levels = frame(spark, RNG.normal(size=(60, 4))), [3, 4, 5], partition.grow_level, []
    single = [recursive_partition(v, 12, 3, seed) for seed in seeds]
    monkeypatch.setattr(partition, "grow_level", lambda *args: levels.append(args[-1]) or grow(*args))
    trees = partition.partition_forest(v, 12, 3, seeds)
    assert levels == list(range(len(levels)))
    for a, b in zip(single, trees):
        assert a.sizes == b.sizes and all(np.array_equal(a.centroids[p], b.centroids[p]) for p in a.centroids.keys() | b.centroids.keys())
    assert partition.forest_routed(v, trees).count() == 180


def test_driver_lets_go_once_its_heap_is_half_full():
    calls = []

    class Runtime:
        getRuntime = staticmethod(lambda: Runtime)
        maxMemory = staticmethod(lambda: 100)

    class Spark:
        class _jvm:
            class java:
                lang = type("lang", (), {"Runtime": Runtime})

            System = type("System", (), {"gc": staticmethod(lambda: calls.append(1))})

    for size in (40, 60):
        Runtime.totalMemory = staticmethod(lambda: size)
        tables._released(Spark)
    assert len(calls) == 1


def test_trees_below_a_block_grow_in_one_task_as_level_by_level(spark, monkeypatch):
    """The same leaves and lists whether a tree is grown by jobs, in one task, or in both ways; and no job for each level."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4).round(1)]) for i in range(150)] + [(150 + i, [1.0] * 4) for i in range(30)]
    v = spark.createDataFrame(rows, "id long, vec array<float>")
    build = lambda **o: sorted(map(tuple, forest_knn(v, 3, alpha=12, rho=3, tau=0, max_epochs=2, trees=3, **o).collect()))
    want = build(history=History())
    levels, grow = [], partition.grow_level
    monkeypatch.setattr(partition, "grow_level", lambda *a: levels.append(1) or grow(*a))
    assert build() == want and not levels
    monkeypatch.setattr(partition, "WHOLE", 40)
    assert build() == want and levels
    assert sorted(spark.createDataFrame([(x,) for x in partition.apart(spark, 6)], "x long").repartition(6, "x").rdd.glom().map(len).collect()) == [1] * 6
