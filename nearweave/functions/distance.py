"""Distances between vectors: column expressions for SQL and numpy kernels for the heavy work, all in doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 where a vector has no length."""
    square = lambda c: _sum(F.transform(c, lambda x: x.cast("double") * x.cast("double")))
    length = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(length == 0, F.lit(1.0)).otherwise(1.0 - _paired(a, b, lambda x, y: x * y) / F.when(length == 0, F.lit(1.0)).otherwise(length))


def _np_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("...i,...i->...", d, d))


def _np_l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).sum(-1)


def _np_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
    dot = (a * b).sum(-1)
    return np.where(length == 0, 1.0, 1.0 - dot / np.where(length == 0, 1.0, length))


def _short_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def _short_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return np.where(length == 0, 1.0, 1.0 - (a @ b.T) / np.where(length == 0, 1.0, length))


@dataclass(frozen=True)
class Metric:
    """``column``: expression on two array columns; ``rows``: kernel on aligned rows; ``table``: all pairs, in the same
    order as the distance but not always the distance itself nor exact to the last bit (for short lists). A table in single
    precision is right but for one rounding of its largest value for each dimension and one more."""

    name: str
    column: Callable[[Column, Column], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    table: Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Rows and columns of a part of a table that stays in a core's cache while the dimensions are summed.
_PART = 8, 2048
#: Vectors below this, if single precision holds them, are summed in it.
_SINGLE = 1e30


def _single(x: np.ndarray) -> bool:
    y = np.abs(x)
    return bool((y <= _SINGLE).all() and (x.astype(np.float32) == x).all() and not ((y > 0) & (y < 1 / _SINGLE)).any())


def _table_l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = np.float32 if _single(a) and _single(b) else np.float64
    a, columns, out = a.astype(kind), np.ascontiguousarray(b.T, kind), np.zeros((len(a), len(b)), kind)
    rows, width = _PART
    difference, total = np.empty((2, rows, width), kind)
    for j in range(0, len(b), width):
        part = columns[:, j : j + width]
        for i in range(0, len(a), rows):
            x = a[i : i + rows, :, None]
            d, t = difference[: len(x), : part.shape[1]], total[: len(x), : part.shape[1]]
            t[:] = 0
            for z in range(a.shape[1]):
                np.subtract(x[:, z], part[z], out=d)
                np.abs(d, out=d)
                t += d
            out[i : i + rows, j : j + width] = t
    return out


METRICS: dict[str, Metric] = {
    "l2": Metric("l2", l2, _np_l2, _short_l2),
    "l1": Metric("l1", l1, _np_l1, _table_l1),
    "cosine": Metric("cosine", cosine, _np_cosine, _short_cosine),
}


def metric(name: str | Metric) -> Metric:
    """A metric by its name, or one of the user's own."""
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def register_sql(spark: SparkSession) -> None:
    """vector_l1, vector_l2 and vector_cosine for SQL texts, as SQL functions that the optimizer inlines."""
    pair = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    square = "sqrt(aggregate(transform({0}, x -> double(x) * double(x)), 0D, (s, x) -> s + x))"
    length = f"{square.format('a')} * {square.format('b')}"
    bodies = {
        "l2": f"sqrt({pair.format('(double(x) - double(y)) * (double(x) - double(y))')})",
        "l1": pair.format("abs(double(x) - double(y))"),
        "cosine": f"CASE WHEN {length} = 0 THEN 1D ELSE 1D - {pair.format('double(x) * double(y)')} / ({length}) END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_{name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
