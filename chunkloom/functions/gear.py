"""Gear hash: a rolling hash of the last 32 bytes, as numpy kernels and as column expressions."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 32
MASK32 = 0xFFFFFFFF


@lru_cache(maxsize=8)
def gear_table(path: str | None = None) -> np.ndarray:
    """256 numbers of 32 bits: by rule the first 8 hex digits of md5 of the byte's decimal digits.

    path: a text file of 256 numbers to use instead, for chunks that must agree with another program's.
    """
    if path:
        with open(path) as f:
            values = [int(x, 0) for x in f.read().replace(",", " ").split()]
        if len(values) != 256:
            raise ValueError(f"{path} has {len(values)} numbers, not 256")
        return np.array(values, dtype=np.uint32)
    return np.array([int(hashlib.md5(str(b).encode()).hexdigest()[:8], 16) for b in range(256)], dtype=np.uint32)


def load_table(path: str) -> tuple[int, ...]:
    """A table for ChunkConfig.gear, read from a text file."""
    return tuple(gear_table(path).tolist())


def _rolled(values: np.ndarray) -> np.ndarray:
    """Five shifted additions instead of a loop over positions."""
    h = values
    for s in (1, 2, 4, 8, 16):
        if len(h) <= s:
            break
        nxt = h.copy()
        nxt[s:] += h[:-s] << np.uint32(s)
        h = nxt
    return h


def gear_hashes(data: bytes | memoryview | np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The hash at every position: sum over k < 32 of table[byte k before] * 2^k, modulo 2^32."""
    return _rolled((gear_table() if table is None else table)[np.frombuffer(data, dtype=np.uint8)])


def gear_hashes_of(parts: list[bytes], table: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """Hashes of several streams in one array, and where each starts in it; 31 unused positions stand between them."""
    values, starts, at = gear_table() if table is None else table, [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + WINDOW - 1
    flat = np.zeros(at, dtype=np.uint32)
    for p, s in zip(parts, starts):
        flat[s : s + len(p)] = values[np.frombuffer(p, dtype=np.uint8)]
    return _rolled(flat), starts


def gear_at(data: Column, position: Column, table: np.ndarray | None = None) -> Column:
    """Column: the hash of the 32 bytes that end at position (from 0)."""
    values = F.array(*(F.lit(int(x)) for x in (gear_table() if table is None else table)))
    first = F.greatest(position - (WINDOW - 1), F.lit(0)).cast("int")
    size = F.greatest(F.least(position.cast("int") + 1, F.octet_length(data)) - first, F.lit(0))
    # Two hex digits for each byte; summed up from the oldest.
    digits = F.hex(F.substring(data, first + 1, size))
    step = lambda acc, i: (acc * 2 + F.element_at(values, F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1)).bitwiseAND(F.lit(MASK32))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0).cast("long"), step))


def binary_digits(h: Column) -> Column:
    return F.lpad(F.bin(h), 32, "0")


def candidate_type(h: Column, hard: int, medium: int, easy: int, *, normalized: bool = True, backup: bool = True) -> Column:
    """The strongest condition that a candidate's hash fulfils: H, E or B."""
    strong = F.when(h < hard, "H") if normalized else F.when(h < medium, "H")
    if normalized:
        strong = strong.when(h < easy, "E")
    return strong.otherwise("B") if backup else strong


def invariant(previous_hard: Column, distance: Column, kind: Column, min_size: int, avg_size: int, max_size: int) -> Column:
    """Whether a cut at this candidate follows whatever cuts came before its predecessor."""
    eligible = ((kind == "H") & (distance >= min_size)) | ((kind == "E") & (distance >= avg_size))
    return F.coalesce(previous_hard & (distance + min_size <= max_size) & eligible, F.lit(False))
