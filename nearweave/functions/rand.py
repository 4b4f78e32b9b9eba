"""Reproducible choices by hash, the same in Spark and in SQL: no result depends on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Mersenne prime: products of two residues stay within 64 bits.
PRIME = 2_147_483_647


def _residue(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME).cast("long"))


def _stir(x: Column) -> Column:
    r = _residue(x)
    return _residue(_residue(r * r) * 48271)


def hash_one(u: Column, seed: int) -> Column:
    """A pseudo-random long below PRIME for an id."""
    return _stir(_residue(u.cast("long")) * 1103515245 + (seed * 12345 + 1013904223))


def hash_two(u: Column, v: Column, seed: int) -> Column:
    """A pseudo-random long below PRIME for an ordered pair."""
    return _stir(hash_one(u, seed) * 40503 + _residue(v.cast("long")) * 69069 + 7)


def sql_one(u: str, seed: int) -> str:
    return _sql_stir(f"(({u}) % {PRIME}) * 1103515245 + {seed * 12345 + 1013904223}")


def sql_two(u: str, v: str, seed: int) -> str:
    return _sql_stir(f"({sql_one(u, seed)}) * 40503 + (({v}) % {PRIME}) * 69069 + 7")


def _sql_stir(x: str) -> str:
    return f"(((((({x}) % {PRIME})::BIGINT * (({x}) % {PRIME})::BIGINT) % {PRIME}) * 48271) % {PRIME})"


def derive(seed: int, *parts: int) -> int:
    """A seed of its own for each purpose, epoch, level or round."""
    for p in parts:
        seed = (seed * 1_000_003 + p * 7919 + 1) % 100_000
    return seed
