"""Parameters of chunking, resemblance and planning."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in bytes and the options of the cut rule."""

    min_size: int = 64
    avg_size: int = 256
    max_size: int = 2048
    normalized: bool = True  # a hard condition before the average size, an easy one after it
    backup: bool = True  # a still easier condition instead of a forced cut
    gear: tuple[int, ...] | None = None  # 256 numbers of another program's rolling hash (functions.gear.load_table); None: the own rule's

    def __post_init__(self) -> None:
        if not 1 <= self.min_size <= self.avg_size <= self.max_size or self.avg_size < 4:
            raise ValueError(f"sizes must not decrease: {self.min_size}, {self.avg_size}, {self.max_size}")
        if self.gear is not None and len(self.gear) != 256:
            raise ValueError(f"a gear table has 256 numbers, not {len(self.gear)}")

    @cached_property
    def bits(self) -> int:
        """log2 of the average size, rounded half away from zero."""
        return math.floor(math.log2(self.avg_size) + 0.5)

    def threshold(self, kind: str) -> int:
        """A hash fulfils a condition if it is below 2^(32 - bits of its mask)."""
        extra = {"hard": 1, "medium": 0, "easy": -1, "backup": -2}[kind]
        return 1 << (32 - self.bits - extra)

    @cached_property
    def easiest(self) -> int:
        if self.backup:
            return self.threshold("backup")
        return self.threshold("easy" if self.normalized else "medium")

    @cached_property
    def table(self) -> np.ndarray | None:
        return None if self.gear is None else np.array(self.gear, dtype=np.uint32)

    def with_(self, **changes) -> ChunkConfig:
        return replace(self, **changes)


#: Ranges that sizes must lie in where they come from outside (fixed limits).
SIZE_LIMITS = {"min_size": (64, 64 << 20), "avg_size": (256, 256 << 20), "max_size": (1024, 1 << 30)}


def checked(cfg: ChunkConfig) -> ChunkConfig:
    """cfg, if its sizes lie in the supported ranges."""
    for name, (low, high) in SIZE_LIMITS.items():
        if not low <= getattr(cfg, name) <= high:
            raise ValueError(f"{name} {getattr(cfg, name)} is not between {low} and {high}")
    return cfg


COMPRESS = ChunkConfig(64, 256, 2048)
LARGE = ChunkConfig(2048, 8192, 65536)


@dataclass(frozen=True)
class PlanConfig:
    """Options of the copy/insert plan of a stream."""

    chunks: ChunkConfig = COMPRESS
    dictionary: int | None = None  # bytes a copy may reach back; None: without limit
    lz77: bool = True  # duplicates take room in the dictionary like other chunks
    delta: str | None = "minichunks"  # None, "shingling" or "minichunks"
    minichunk: int = 16
    max_distance: int = 32  # hamming distance of similar chunks
    min_saving: int = 128  # a delta must save more
    adjacency: bool = True  # try the chunk after the previous chunk's match
    adjacency_back: bool = True  # and walk back from there
    exhaustive_adjacency: bool = False  # try what follows any instance of the previous match
    generalized: bool = False  # latest chunk of the same hamming base
    window: int = 0  # similar chunks among so many previous ones
    features: bool = False  # chunks that share super-features
    extend_forward: bool = True
    extend_back: bool = True
    omit_below: int = 128  # copies shorter than this are not worth an instruction
    try_all: bool = False  # try every candidate instead of the nearest only
