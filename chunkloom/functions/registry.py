"""Functions under names for SQL: spark.sql can call them once register() has run."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.config import ChunkConfig, PlanConfig
from chunkloom.functions import bits
from chunkloom.functions.gear import gear_hashes
from chunkloom.operators import chunking, delta, resemblance
from chunkloom.plans.lz import encode_stream
from chunkloom.sources import container

CHUNK = "array<struct<offset: bigint, size: bigint>>"
STEPS = "array<struct<type: string, offset: bigint, size: bigint>>"


def _chunks(cuts: list[int]) -> list[tuple[int, int]]:
    return [(a, b - a) for a, b in zip([0, *cuts], cuts)]


def _signed(x: int, width: int = 64) -> int:
    return x - (1 << width) if x >> (width - 1) else x


def _scalar(result: str):
    """A vectorised function of columns from one of values; null in, null out."""

    def make(f):
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

        return F.pandas_udf(run, T.DataType.fromDDL(result))

    return make


def functions() -> dict[str, object]:
    return {
        "chunk_cdc": _scalar(CHUNK)(lambda data, low, avg, high: _chunks(chunking.cdc_cuts(data, ChunkConfig(low, avg, high)))),
        "chunk_two_stage": _scalar(CHUNK)(lambda data, low, avg, high: _chunks(chunking.two_stage_cuts(data, ChunkConfig(low, avg, high)))),
        "chunk_fixed": _scalar(CHUNK)(lambda data, size: _chunks(chunking.fixed_cuts(data, size))),
        "gear_hash": _scalar("bigint")(lambda data: int(gear_hashes(data)[-1]) if data else 0),
        "simhash64": _scalar("bigint")(lambda data, size: _signed(resemblance.simhash(data, size)[0])),
        "super_features": _scalar("array<bigint>")(lambda data: resemblance.super_features(f) if (f := resemblance.features(data)) else None),
        "delta_encode": _scalar(STEPS)(lambda chunk, similar, size: delta.delta(chunk, similar, size)),
        "common_prefix": _scalar("bigint")(bits.common_prefix),
        "common_suffix": _scalar("bigint")(bits.common_suffix),
        "xxh3_64": _scalar("bigint")(lambda data: _signed(xxhash.xxh3_64_intdigest(data))),
        "xxh64_hex": _scalar("string")(lambda data: xxhash.xxh64_hexdigest(data, seed=0).upper()),
        "vli_encode": _scalar("binary")(bits.vli_encode),
        "vli_decode": _scalar("bigint")(lambda data: bits.vli_decode(data)[0]),
        "lz_plan": _scalar(STEPS)(lambda data: encode_stream(data, PlanConfig())[0]),
        "container_encode": _scalar("binary")(lambda data: container.write_container(data, encode_stream(data, PlanConfig())[0])),
        "container_decode": _scalar("binary")(lambda data: container.decode_container(data)),
    }


def register(spark: SparkSession) -> list[str]:
    """Register all; returns their names."""
    for name, f in (made := functions()).items():
        spark.udf.register(name, f)
    return list(made)
