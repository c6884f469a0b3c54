"""Similar chunks: SimHash, hamming buckets, features and super-features, candidates and their ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.config import ChunkConfig
from chunkloom.functions.bits import hamming_base, hamming_distance
from chunkloom.functions.gear import gear_hashes
from chunkloom.operators.chunking import cdc_cuts, fixed_cuts

#: Multipliers and addends of the 16 features: consecutive primes (fixed values).
FEATURE_COEFFICIENTS = (
    (2, 3), (3, 5), (5, 7), (7, 11), (11, 13), (13, 17), (17, 19), (19, 23),
    (23, 29), (29, 31), (31, 37), (37, 41), (41, 43), (43, 47), (47, 53), (53, 59),
)
#: Positions whose gear hash has none of these bits are sampled for features (fixed value).
SAMPLING_MASK = 0x40030341


@lru_cache(maxsize=32)
def minichunk_config(size: int) -> ChunkConfig:
    return ChunkConfig(size // 2, size, 2 * size)


def minichunk_cuts(data: bytes, size: int, content_defined: bool = True) -> list[int]:
    """Parts of a chunk: fixed blocks, or content-defined ones of half to twice the size."""
    return cdc_cuts(data, minichunk_config(size)) if content_defined else fixed_cuts(data, size)


def simhash_of(hashes: Sequence[int] | np.ndarray) -> int:
    """Majority of each of 64 bits over the hashes; ties and no hash give 0."""
    h = np.asarray(hashes, dtype=np.uint64)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view(np.uint64)[0])


def simhash(data: bytes, size: int = 16, content_defined: bool = True) -> tuple[int, list[int]]:
    """SimHash of a chunk and its parts' ends."""
    cuts = minichunk_cuts(data, size, content_defined)
    return simhash_of([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *cuts], cuts)]), cuts


def features(data: bytes) -> list[int] | None:
    """16 maxima over sampled positions, or None if none is sampled."""
    h = gear_hashes(data).astype(np.uint64)
    h = h[(h & np.uint64(SAMPLING_MASK)) == 0]
    if not len(h):
        return None
    return [int(((h * np.uint64(m) + np.uint64(a)) & np.uint64(0xFFFFFFFF)).max()) for m, a in FEATURE_COEFFICIENTS]


def super_features(values: Sequence[int]) -> list[int]:
    """4 hashes of 4 features each."""
    return [xxhash.xxh32_intdigest(np.array(values[i : i + 4], dtype=np.uint32).tobytes(), seed=SAMPLING_MASK) for i in range(0, 16, 4)]


def with_similarity(chunks: DataFrame, *, size: int = 16, content_defined: bool = True, data_col: str = "data") -> DataFrame:
    """chunks (with data) and lsh, super_features (null if nothing was sampled)."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("lsh", T.LongType()), T.StructField("super_features", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lsh, found = [], []
            for cell in b[data_col]:
                data = cell.as_py() or b""
                value = simhash(data, size, content_defined)[0]
                lsh.append(value - (1 << 64) if value >> 63 else value)
                f = features(data)
                found.append(super_features(f) if f else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lsh, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names, "lsh", "super_features"])

    return chunks.mapInArrow(run, schema)


def simhash_aggregate(high: Column, low: Column) -> tuple[Column, Column]:
    """SimHash as an aggregate with built-in functions over two 32-bit halves of hashes: both halves of the result."""
    def half(h: Column) -> Column:
        total = F.lit(0).cast("long")
        for k in range(32):
            total = total + F.when(F.sum(F.getbit(h, F.lit(k)).cast("int") * 2 - 1) > 0, F.lit(1 << k)).otherwise(F.lit(0))
        return total

    return half(high), half(low)


def previous_similar(chunks: DataFrame, window: int, max_distance: int) -> DataFrame:
    """Pairs (chunk_i, similar_i, distance) with the `window` chunks before it in the stream within max_distance."""
    w = Window.partitionBy("stream_id").orderBy("chunk_i")
    near = F.collect_list(F.struct("chunk_i", "lsh")).over(w.rowsBetween(-window, -1))  # at most `window` elements
    pairs = chunks.withColumn("near", near).select("stream_id", "chunk_i", "lsh", F.explode("near").alias("s"))
    distance = hamming_distance(F.col("lsh"), F.col("s.lsh")).cast("long")
    return pairs.select("stream_id", "chunk_i", F.col("s.chunk_i").alias("similar_i"), distance.alias("distance")).filter(F.col("distance") <= max_distance)


def same_base(chunks: DataFrame) -> DataFrame:
    """chunks with similar_i: the latest chunk before it in the stream with the same hamming base."""
    based = chunks.withColumn("base", hamming_base(F.col("lsh")))
    return based.withColumn("similar_i", F.lag("chunk_i").over(Window.partitionBy("stream_id", "base").orderBy("chunk_i")))


def sharing_features(chunks: DataFrame) -> DataFrame:
    """stream_id, chunk_i, similar_i, shared: all earlier chunks of the stream with equal super-features, and how many.

    As in an index that keeps every holder of a super-feature but drops one when a later chunk matches it in all: a chunk is met up to
    the next one that equals it there.
    """
    order = Window.partitionBy("stream_id", "super_features").orderBy("chunk_i")
    single = chunks.withColumn("until", F.lead("chunk_i").over(order)).select("stream_id", "chunk_i", "until", F.posexplode("super_features").alias("k", "sf"))
    held = single.select("stream_id", "k", "sf", F.col("chunk_i").alias("similar_i"), "until")
    met = single.drop("until").join(held, ["stream_id", "k", "sf"]).filter((F.col("similar_i") < F.col("chunk_i")) & (F.col("until").isNull() | (F.col("chunk_i") <= F.col("until"))))
    return met.groupBy("stream_id", "chunk_i", "similar_i").agg(F.count(F.lit(1)).alias("shared"))


def after_match(chunks: DataFrame) -> DataFrame:
    """stream_id, chunk_i, similar_i: the chunk behind the latest match of the previous chunk, for chunks with no match."""
    w = Window.partitionBy("stream_id", "hash").orderBy("chunk_i")
    matched = chunks.withColumn("match_i", F.lag("chunk_i").over(w))
    anchor = F.lag("match_i").over(Window.partitionBy("stream_id").orderBy("chunk_i"))
    return matched.withColumn("similar_i", anchor + 1).filter("match_i IS NULL AND similar_i < chunk_i").select("stream_id", "chunk_i", "similar_i")


def best_candidate(pairs: DataFrame) -> DataFrame:
    """The nearest candidate of each chunk, ties to the later one."""
    w = Window.partitionBy("stream_id", "chunk_i").orderBy(F.asc("distance"), F.desc("similar_i"))
    return pairs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
