"""Shared helpers: table readers, reliable intermediate tables, and vectorised word handling on Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import free_pages
from ..plans.tables import settle as materialise  # noqa: F401  cuts lineage with a written table

#: Bytes of text handled by one numpy pass; a longer single document forms a pass of its own.
PASS_BYTES = 1 << 21
#: The filters on ids have 64 bits in each of 2 ** FILTER longs; they tell apart so many ids.
FILTER = 19
FILTERED = 8 << FILTER
U64 = np.uint64
_MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(docs: DataFrame) -> DataFrame:
    """The two columns that operators on whole texts need; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Stands for a null doc_id, before all others.
LOWEST = -(2**63)


def lowest_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))


def constant(values: DataFrame, value: Column, bits: int) -> Column:
    """One array of 2 ** bits numbers from a table with a row (k long, value) for every place k: blocks first, then the whole."""
    blocks = values.groupBy(F.shiftright("k", bits // 2).alias("h")).agg(F.sort_array(F.collect_list(F.struct("k", value.alias("x")))).alias("x"))
    blocks = blocks.select("h", F.transform("x", lambda x: x["x"]).alias("x"))
    return blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("h", "x"))), lambda x: x["x"])).alias("x")).scalar()


def zeros(docs: DataFrame, bits: int) -> DataFrame:
    """k and 0 for every place."""
    return docs.sparkSession.range(1 << bits).select(F.col("id").alias("k"), F.lit(0).cast("long"))


def _bit(columns: tuple[str | Column, ...]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(64 << FILTER))


def id_filter(ids: DataFrame, *columns: str) -> Column:
    """Bits of the ids' hashes in a fixed number of longs. Ids that aren't there may pass, too."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(columns).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = ids.select(F.shiftright(_bit(columns), 6).alias("k"), bit.alias("x")).union(zeros(ids, FILTER))
    return constant(words.groupBy("k").agg(F.bit_or("x").alias("x")), F.col("x"), FILTER)


def may_hold(bits: Column, *columns: str | Column) -> Column:
    return F.bit_get(F.element_at(bits, F.shiftright(_bit(columns), 6).cast("int") + 1), _bit(columns).bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` on the batches of a task; what its passes leave in the worker's heap goes back to the system at its end.

    Workers wait for further tasks, beside whatever their executor does until then.
    """

    def task(batches):
        yield from run(batches)
        free_pages()

    return task


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1, from 0) of a string or binary array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose texts together stay near ``limit`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: spreads entropy over all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Word separators: space and the five ASCII controls from tab to carriage return.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64 for prefix hashes.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of consecutive texts, and for each text the index of its first word.

    A word never crosses the end of a text. The index array has one entry more than there are texts.
    """
    n = len(body)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from prefix sums of a polynomial over the bytes, without a loop over words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(body)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * _powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive word hashes: position i covers words i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = U64((2 * seed + 0xC2B2AE3D27D4EB4F) & _MASK | 1)
    out = np.full(n, seed & _MASK, np.uint64)
    for j in range(k):
        out = out * base + h[j : j + n]
    return mix(out)
