"""Solvers for one block of vectors in memory, and their application to all blocks.

A block is bounded: the partitioning keeps it at or below alpha vectors. Blocks up to a cutoff are solved exactly, larger
ones by local neighbour descent from a small forest of random partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.distance import Metric, metric

CUTOFF = 10_000
#: Rows of a tile of the distance table, and its bytes, at most.
TILE, TILE_BYTES = 1024, 64 << 20
#: Bytes of the vectors that a tile of points gathers at once.
GATHERED = 64 << 20


def brute_force(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray, k: int, m: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact u, v, d: the k nearest of y for each row of x, without its own id; ties by the smaller id.

    A table that is exact up to rounding shortens the lists; kept pairs get their true distance.
    """
    us, vs, ds = [], [], []
    step = max(1, min(TILE, TILE_BYTES // (8 * max(1, len(y)))))
    for a in range(0, len(x) if len(y) else 0, step):
        tile, ids = x[a : a + step], x_ids[a : a + step]
        near = m.table(tile, y)
        rounding = 1e-9 if near.dtype == np.float64 else (x.shape[1] + 2) * float(np.finfo(near.dtype).eps)
        near[ids[:, None] == y_ids[None, :]] = np.inf
        kth = np.partition(near, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        real = np.isfinite(near)
        finite = np.where(np.isfinite(kth), kth, np.where(real, near, 0).max(1))
        slack = rounding * (1 + np.abs(np.where(real, near, 0)).max(1))
        row, col = np.nonzero(real & (near <= (finite + slack)[:, None]))
        d = m.rows(tile[row], y[col])
        order = np.lexsort((y_ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(tile)))
        keep = np.arange(len(row)) - first[row] < k
        us.append(ids[row[keep]])
        vs.append(y_ids[col[keep]])
        ds.append(d[keep])
    cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
    return cat(us, np.int64), cat(vs, np.int64), cat(ds, np.float64)


class _Lists:
    """k nearest of each of n points; fresh entries have not been taken to a local join yet."""

    def __init__(self, n: int, k: int):
        self.id = np.full((n, k), -1, np.int64)
        self.d = np.full((n, k), np.inf)
        self.fresh = np.zeros((n, k), bool)

    def push(self, points: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> int:
        """Offer v at distance d to points[u]; an entry that is there stays as it is. Returns how many new entries stay."""
        k = self.id.shape[1]
        near = d <= self.d[points[u], -1]
        u, v, d = u[near], v[near], d[near]
        rows, cols = np.nonzero(self.id[points] >= 0)
        old = points[rows]
        u, v, d = np.concatenate([rows, u]), np.concatenate([self.id[old, cols], v]), np.concatenate([self.d[old, cols], d])
        state = np.concatenate([self.fresh[old, cols].astype(np.int8), np.full(len(u) - len(rows), 2, np.int8)])  # 2: just offered
        order = np.lexsort((state == 2, v, u))
        u, v, d, state = u[order], v[order], d[order], state[order]
        first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
        u, v, d, state = u[first], v[first], d[first], state[first]
        order = np.lexsort((v, d, u))
        u, v, d, state = u[order], v[order], d[order], state[order]
        place = np.arange(len(u)) - np.searchsorted(u, np.arange(len(points)))[u]
        keep = place < k
        u, v, d, state, place = points[u[keep]], v[keep], d[keep], state[keep], place[keep]
        self.id[points], self.d[points], self.fresh[points] = -1, np.inf, False
        self.id[u, place], self.d[u, place], self.fresh[u, place] = v, d, state > 0
        return int((state == 2).sum())


def _divide(x: np.ndarray, members: np.ndarray, ways: int, leaf: int, m: Metric, r: np.random.Generator) -> list[np.ndarray]:
    """Blocks of at most ``leaf`` members around random members; ties among all branches go to a random one."""
    done, todo = [], [members]
    while todo:
        block = todo.pop()
        if len(block) <= leaf:
            done.append(block)
            continue
        centre = r.choice(block, min(ways, len(block)), replace=False)
        near = m.table(x[block], x[centre])
        branch = near.argmin(1)
        even = np.ptp(near, axis=1) <= 1e-12
        branch[even] = r.integers(0, len(centre), int(even.sum()))
        parts = [block[branch == i] for i in range(len(centre))]
        todo += [p for p in parts if 0 < len(p) < len(block)] or [p for p in np.array_split(r.permutation(block), ways) if len(p)]
    return done


def _sampled(lists: _Lists, sample: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each point a random few of the ends of its fresh edges, in both directions, and of its other edges (-1: none).

    Fresh entries that are taken age; those that no sample took stay fresh for the next turn.
    """
    n = len(lists.id)
    out = []
    for kind in (True, False):
        rows, cols = np.nonzero((lists.id >= 0) & (lists.fresh == kind))
        ends, edge = lists.id[rows, cols], np.arange(len(rows))
        a, b, edge = np.concatenate([rows, ends]), np.concatenate([ends, rows]), np.concatenate([edge, edge])
        order = np.lexsort((r.random(len(a), np.float32), a))
        a, b, edge = a[order], b[order], edge[order]
        place = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
        keep = place < sample
        table = np.full((n, sample), -1, np.int64)
        table[a[keep], place[keep]] = b[keep]
        out.append((table, rows, cols, edge[keep]))
    table, rows, cols, taken = out[0]
    lists.fresh[rows[taken], cols[taken]] = False
    return table, out[1][0]


def local_descent(x: np.ndarray, k: int, m: Metric, seed: int, rounds: int = 50, sample: int | None = None, threshold: float = 0.001, trees: int = 3, ways: int = 5, leaf: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Approximate neighbour indices and distances of all rows of x (-1 where fewer than k are known).

    A point meets the sampled neighbours of its sampled neighbours, if one of the two edges is fresh. Points go in tiles: a
    tile's offers are measured and cut to k before the next tile, so that memory is the lists, the samples and one tile.
    """
    n, r = len(x), np.random.default_rng(seed)
    k = min(k, n - 1)
    sample = sample or max(1, k // 2)
    lists, every = _Lists(n, k), np.arange(n)
    for _ in range(trees):
        for block in _divide(x, every, ways, leaf, m, r):
            if len(block) > 1:
                u, v, d = brute_force(x[block], x[block], np.arange(len(block)), np.arange(len(block)), k, m)
                lists.push(block, u, block[v], d)
    tile = max(1, GATHERED // (3 * sample * sample * x.shape[1] * x.itemsize))
    for _ in range(rounds):
        new, old = _sampled(lists, sample, r)
        changed = 0
        for a in range(0, n, tile):
            points = every[a : a + tile]
            ends = [np.where(centre[points][:, :, None] >= 0, to[centre[points]], -1).reshape(len(points), -1) for centre, to in ((new, new), (new, old), (old, new))]
            met = np.sort(np.concatenate(ends, 1), 1)
            good = (met >= 0) & (met != points[:, None])
            good[:, 1:] &= met[:, 1:] != met[:, :-1]
            u, place = np.nonzero(good)
            v = met[u, place]
            changed += lists.push(points, u, v, m.rows(x[points[u]], x[v]))
        if changed <= int(n * k * threshold):
            break
    return lists.id, lists.d


def solve_block(ids: np.ndarray, x: np.ndarray, k: int, m: Metric, cutoff: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, d of one block: exact up to ``cutoff`` members, else by local descent. Members are put in order of ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if len(ids) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(ids) <= cutoff:
        return brute_force(x, x, ids, ids, k, m)
    near, d = local_descent(x, k, m, seed)
    row, col = np.nonzero(near >= 0)
    return ids[row], ids[near[row, col]], d[row, col]


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows, -1)


def edge_batch(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d, pa.float64())})


def leaf_solver(k: int, m: Metric, cutoff: int, seed: int) -> Callable[[str, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """u, v, d of a block from its path, ids and vectors."""
    return lambda path, ids, x: solve_block(ids, x, k, m, cutoff, int.from_bytes(path.encode()[-6:], "little") + seed)


def leaf_knn(blocks: DataFrame, k: int, metric_name: str | Metric = "l2", cutoff: int = CUTOFF, seed: int = 0) -> DataFrame:
    """u, v, d of every block (columns path, id, vec): one task solves one block."""
    solver = leaf_solver(k, metric(metric_name), cutoff, seed)

    def solve(block: pa.Table) -> pa.Table:
        return edge_batch(*solver(str(block.column("path")[0].as_py()), np.asarray(block.column("id")), matrix(block.column("vec"), block.num_rows)))

    return blocks.select("path", "id", "vec").groupBy("path").applyInArrow(solve, "u long, v long, d double")
