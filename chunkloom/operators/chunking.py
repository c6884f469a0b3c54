"""Chunking: fixed blocks, content-defined cuts of whole streams and of segments, and two-stage cutting by one mask.

Cut positions are exclusive: the byte at a cut starts the next chunk. With the last cut p and a stream of n bytes the
next cut is the first of

1. the first hard position in [p + min, min(p + avg, n)),
2. the first easy position in [p + avg, min(p + max, n)),
3. n, if fewer than max bytes are left,
4. the first backup position in [p + avg, p + max),
5. p + max.

Streams that fit a row are cut in one Arrow pass. Longer ones come as segments: each emits every position that fulfils the
easiest condition (that does not depend on how the stream was cut into segments), and one fold over a stream's positions picks the cuts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.config import COMPRESS, ChunkConfig
from chunkloom.functions.gear import WINDOW, gear_hashes, gear_hashes_of

LONG, INT, TEXT, BINARY = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()
HASHED_AT_ONCE = 1 << 20  # bytes of short streams in one numpy call


def select_cuts(end: int, hard: list[int], easy: list[int], backup: list[int], cfg: ChunkConfig, start: int = 0) -> list[int]:
    """The rule above for the stream in [start, end), on sorted positions; the last cut is end (none if it is empty).

    The lists may hold positions of other streams around it.
    """
    cuts: list[int] = []
    p, low, avg, high = start, cfg.min_size, cfg.avg_size, cfg.max_size
    while p < end:
        stop = p + avg if p + avg < end else end
        k = bisect_left(hard, p + low)
        if k < len(hard) and hard[k] < stop:
            p = hard[k]
        else:
            stop = p + high if p + high < end else end
            k = bisect_left(easy, p + avg)
            if k < len(easy) and easy[k] < stop:
                p = easy[k]
            elif end - p < high:
                p = end
            else:
                k = bisect_left(backup, p + avg)
                p = backup[k] if k < len(backup) and backup[k] < p + high else p + high
        cuts.append(p)
    return cuts


def positions(h: np.ndarray, cfg: ChunkConfig) -> tuple[list[int], list[int], list[int]]:
    """Positions that are hard, easy and backup, from hashes."""
    at = np.flatnonzero(h < cfg.easiest)
    return split_positions(at, h[at], cfg)


def split_positions(at: np.ndarray, h: np.ndarray, cfg: ChunkConfig) -> tuple[list[int], list[int], list[int]]:
    if cfg.normalized:
        hard, easy = at[h < cfg.threshold("hard")].tolist(), at[h < cfg.threshold("easy")].tolist()
    else:
        hard = easy = at[h < cfg.threshold("medium")].tolist()
    return hard, easy, at.tolist() if cfg.backup else []


def cdc_cuts(data: bytes, cfg: ChunkConfig = COMPRESS) -> list[int]:
    """Cuts of one stream."""
    if len(data) <= cfg.min_size:
        return [len(data)] if data else []
    return select_cuts(len(data), *positions(gear_hashes(data, cfg.table), cfg), cfg)


def groups_of(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about HASHED_AT_ONCE bytes."""
    first = size = 0
    for i, p in enumerate(parts):
        size += len(p)
        if size >= HASHED_AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(parts):
        yield first, len(parts)


def cdc_cuts_of(parts: list[bytes], cfg: ChunkConfig = COMPRESS) -> Iterator[list[int]]:
    """Cuts of each stream; short ones are hashed together."""
    for a, b in groups_of(parts):
        h, starts = gear_hashes_of(parts[a:b], cfg.table)
        hard, easy, backup = positions(h, cfg)
        for p, s in zip(parts[a:b], starts):
            cuts = select_cuts(s + len(p), hard, easy, backup, cfg, s)
            yield [c - s for c in cuts] if s else cuts


def two_stage_cuts_of(parts: list[bytes], cfg: ChunkConfig = COMPRESS) -> Iterator[list[int]]:
    for a, b in groups_of(parts):
        h, starts = gear_hashes_of(parts[a:b], cfg.table)
        at = np.flatnonzero(h < cfg.threshold("medium"))
        low, high = np.searchsorted(at, starts), np.searchsorted(at, [s + len(p) for p, s in zip(parts[a:b], starts)])
        for p, s, i, j in zip(parts[a:b], starts, low.tolist(), high.tolist()):
            yield greedy_cuts(len(p), (at[i:j] - s).tolist(), cfg.min_size, cfg.max_size)


def fixed_cuts(data: bytes, size: int) -> list[int]:
    return [*range(size, len(data), size), len(data)] if data else []


def greedy_cuts(n: int, at: list[int], low: int, high: int) -> list[int]:
    """Second stage of two-stage cutting: candidates of one mask, none nearer than low, none further than high."""
    cuts: list[int] = []
    p = 0
    for c in at:
        while p + high < c:
            p += high
            cuts.append(p)
        if c >= p + low and c < n:
            p = c
            cuts.append(p)
    while n - p > high:
        p += high
        cuts.append(p)
    if p < n:
        cuts.append(n)
    return cuts


def two_stage_cuts(data: bytes, cfg: ChunkConfig = COMPRESS) -> list[int]:
    h = gear_hashes(data, cfg.table)
    return greedy_cuts(len(data), np.flatnonzero(h < cfg.threshold("medium")).tolist(), cfg.min_size, cfg.max_size)


def chunk_rows(streams: DataFrame, cut_all: Callable[[list[bytes]], Iterator[list[int]]], *, data_col: str = "data", keep: Sequence[str] = ("stream_id",), with_data: bool = False, digest: bool = True) -> DataFrame:
    """keep, chunk_i, offset, size, hash (md5 in hex) and, if asked for, data of each chunk; null streams have none."""
    kept = list(keep)
    fields = [*streams.select(*kept).schema.fields, T.StructField("chunk_i", LONG), T.StructField("offset", LONG), T.StructField("size", LONG)]
    fields += [T.StructField("hash", TEXT)] * digest + [T.StructField("data", BINARY)] * with_data
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for b in batches:
            data = b[data_col].to_pylist()
            rows = [i for i, d in enumerate(data) if d]
            full = [data[i] for i in rows]
            counts, ends, hashes, parts = [], [], [], []
            for d, cuts in zip(full, cut_all(full)):
                counts.append(len(cuts))
                ends += cuts
                if digest or with_data:
                    start = 0
                    for end in cuts:
                        part = d[start:end]
                        if digest:
                            hashes.append(md5(part).hexdigest())
                        if with_data:
                            parts.append(part)
                        start = end
            n, last = np.array(counts, dtype=np.int64), np.array(ends, dtype=np.int64)
            first = np.cumsum(n) - n  # of each stream's chunks
            offset = np.concatenate(([0], last[:-1])) if len(last) else last
            offset[first] = 0
            at = pa.array(np.repeat(np.array(rows, dtype=np.int64), n))
            cols = [*(b[c].take(at) for c in kept), pa.array(np.arange(len(last)) - np.repeat(first, n)), pa.array(offset), pa.array(last - offset)]
            cols += [pa.array(hashes, pa.string())] * digest + [pa.array(parts, pa.binary())] * with_data
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return streams.select(*kept, data_col).mapInArrow(run, T.StructType(fields))


def cdc_chunks(streams: DataFrame, cfg: ChunkConfig = COMPRESS, **options) -> DataFrame:
    return chunk_rows(streams, lambda parts: cdc_cuts_of(parts, cfg), **options)


def two_stage_chunks(streams: DataFrame, cfg: ChunkConfig = COMPRESS, **options) -> DataFrame:
    return chunk_rows(streams, lambda parts: two_stage_cuts_of(parts, cfg), **options)


def fixed_chunks(streams: DataFrame, size: int, *, data_col: str = "data", keep: Sequence[str] = ("stream_id",), with_data: bool = False) -> DataFrame:
    """Fixed blocks with built-in functions only: the bytes never leave the JVM."""
    n = F.octet_length(data_col)
    starts = streams.filter(n > 0).withColumn("offset", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))))
    part = F.substring(F.col(data_col), F.col("offset") + 1, F.lit(size))
    out = starts.select(*keep, F.floor(F.col("offset") / size).cast("long").alias("chunk_i"), F.col("offset").cast("long").alias("offset"), F.octet_length(part).cast("long").alias("size"), F.md5(part).alias("hash"), part.alias("data"))
    return out if with_data else out.drop("data")


def cut_candidates(streams: DataFrame, cfg: ChunkConfig = COMPRESS, *, data_col: str = "data", keep: Sequence[str] = ("stream_id",), start_col: str | None = None, lead_col: str | None = None, mask: int | None = None) -> DataFrame:
    """keep, offset, gear: every position whose hash fulfils the easiest condition, or with a mask has none of its bits.

    With segments: start_col is the offset of the segment's first own byte in the stream, lead_col the number of bytes before it in data that
    belong to the previous segment (up to 31, so that every window is complete).
    """
    kept = list(keep)
    extra = [c for c in (start_col, lead_col) if c]
    schema = T.StructType([*streams.select(*kept).schema.fields, T.StructField("offset", LONG), T.StructField("gear", LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offsets, gears = [], [], []
            for i, cell in enumerate(b[data_col]):
                data = cell.as_py()
                if not data:
                    continue
                start = b[start_col][i].as_py() if start_col else 0
                lead = b[lead_col][i].as_py() if lead_col else 0
                h = gear_hashes(data, cfg.table)[lead:]
                at = np.flatnonzero(h < cfg.easiest if mask is None else (h & np.uint32(mask)) == 0)
                rows.append(np.full(len(at), i))
                offsets.append(at + start)
                gears.append(h[at].astype(np.int64))
            if rows:
                where = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(b[c].take(where) for c in kept), pa.array(np.concatenate(offsets).astype(np.int64)), pa.array(np.concatenate(gears))], names=[*kept, "offset", "gear"])

    return streams.select(*kept, data_col, *extra).mapInArrow(run, schema)


def segments(streams: DataFrame, size: int, *, id_col: str = "stream_id", data_col: str = "data") -> DataFrame:
    """stream_id, seg_idx, start, lead, is_last, n_bytes, data: pieces that begin up to 31 bytes early."""
    n = F.octet_length(data_col)
    out = streams.filter(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))))
    lead = F.least(F.col("start"), F.lit(WINDOW - 1))
    return out.select(
        F.col(id_col).alias("stream_id"), F.floor(F.col("start") / size).cast("int").alias("seg_idx"), F.col("start").cast("long").alias("start"), lead.cast("long").alias("lead"),
        (F.col("start") + size >= n).alias("is_last"), n.cast("long").alias("n_bytes"), F.substring(F.col(data_col), F.col("start") - lead + 1, lead + size).alias("data"),
    )


def cuts_of_segments(parts: DataFrame, cfg: ChunkConfig = COMPRESS) -> DataFrame:
    """stream_id, chunk_i, offset, size from segments: the fold sees positions and hashes (about one in 64), never the bytes."""
    found = cut_candidates(parts, cfg, keep=["stream_id", "n_bytes"], start_col="start", lead_col="lead")
    ends = parts.filter("is_last").select("stream_id", "n_bytes", F.lit(-1).cast("long").alias("offset"), F.lit(0).cast("long").alias("gear"))
    schema = T.StructType([parts.schema["stream_id"], T.StructField("chunk_i", LONG), T.StructField("offset", LONG), T.StructField("size", LONG)])

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        at, h, n = t["offset"].to_numpy(), t["gear"].to_numpy(), t["n_bytes"][0].as_py()
        real = at >= 0
        cuts = np.array(select_cuts(n, *split_positions(at[real], h[real], cfg), cfg), dtype=np.int64)
        starts = np.concatenate(([0], cuts[:-1]))
        return pa.table({"stream_id": pa.array([key[0].as_py()] * len(cuts), t.schema.field("stream_id").type), "chunk_i": pa.array(np.arange(len(cuts))), "offset": pa.array(starts), "size": pa.array(cuts - starts)})

    return found.unionByName(ends).groupBy("stream_id").applyInArrow(fold, schema)
