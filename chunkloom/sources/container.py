"""The container: a header, then instructions; read and written stream by stream.

Header: four letters, the dictionary's bytes as 8 bytes little-endian (0: without limit), a byte of flags (bit 0: duplicates take room).
Body: a type byte (0 COPY, 1 INSERT), the size as variable-length integer, then the bytes (INSERT) or the distance back (COPY).
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.config import PlanConfig
from chunkloom.functions.bits import vli_decode, vli_encode
from chunkloom.operators.delta import COPY, INSERT, Step
from chunkloom.plans.lz import encode_stream

MAGIC = b"CDCZ"  # fixed value of the format
STATS = ("chunks", "unique_chunks", "dup_bytes", "deduped_bytes", "delta_chunks", "delta_bytes", "instructions", "extended_forward", "extended_back", "omitted", "saved_bytes", "total_bytes")


def write_container(data: bytes, steps: Sequence[Step], dictionary: int | None = None, lz77: bool = True) -> bytes:
    out = bytearray(MAGIC + struct.pack("<QB", dictionary or 0, int(lz77)))
    at = 0
    for kind, source, size in steps:
        # A literal longer than the dictionary is split, so that a decoder may keep no more than that.
        most = size if kind == COPY or not dictionary else dictionary
        for i in range(0, size, most):
            n = min(most, size - i)
            out.append(0 if kind == COPY else 1)
            out += vli_encode(n)
            out += vli_encode(at - source) if kind == COPY else data[source + i : source + i + n]
            at += n
    return bytes(out)


def read_container(blob: bytes) -> tuple[int, bool, list[tuple[str, int, int, bytes]]]:
    """Dictionary bytes, flag, and instructions (type, distance back, size, literal)."""
    if blob[:4] != MAGIC or len(blob) < 13:
        raise ValueError("no container")
    dictionary, flags = struct.unpack_from("<QB", blob, 4)
    at, out = 13, []
    while at < len(blob):
        kind = blob[at]
        if kind > 1:
            raise ValueError(f"unknown instruction {kind} at {at}")
        size, at = vli_decode(blob, at + 1)
        if kind:
            out.append((INSERT, 0, size, blob[at : at + size]))
            at += size
        else:
            back, at = vli_decode(blob, at)
            out.append((COPY, back, size, b""))
    return dictionary, bool(flags & 1), out


def decode_container(blob: bytes) -> bytes:
    """The stream; a copy may overlap what it makes and then repeats it."""
    out = bytearray()
    for kind, back, size, literal in read_container(blob)[2]:
        if kind == INSERT:
            out += literal
            continue
        start = len(out) - back
        if back <= 0 or start < 0:
            raise ValueError("copy from before the stream")
        if back >= size:
            out += out[start : start + size]
        else:
            pattern = bytes(out[start:])
            out += (pattern * (size // back + 1))[:size]
    return bytes(out)


def compress(streams: DataFrame, cfg: PlanConfig = PlanConfig(), *, keep: Sequence[str] = ("stream_id",), data_col: str = "data") -> DataFrame:
    """keep, container and the plan's statistics of each stream (null data: null)."""
    kept = list(keep)
    schema = T.StructType([*streams.select(*kept).schema.fields, T.StructField("container", T.BinaryType()), *(T.StructField(s, T.LongType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, stats = [], []
            for cell in b[data_col]:
                data = cell.as_py()
                if data is None:
                    blobs.append(None)
                    stats.append({})
                    continue
                steps, s = encode_stream(data, cfg)
                blobs.append(write_container(data, steps, cfg.dictionary, cfg.lz77))
                stats.append(s)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(blobs, pa.binary()), *(pa.array([s.get(k) for s in stats], pa.int64()) for k in STATS)], names=[*kept, "container", *STATS])

    return streams.select(*kept, data_col).mapInArrow(run, schema)


def instructions(containers: DataFrame, *, keep: Sequence[str] = ("stream_id",)) -> DataFrame:
    """keep, seq, type, out_offset, src_offset, size of each instruction."""
    kept = list(keep)
    fields = [T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("out_offset", "src_offset", "size"))]
    schema = T.StructType([*containers.select(*kept).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, cell in enumerate(b["container"]):
                if (blob := cell.as_py()) is None:
                    continue
                at = 0
                for k, (kind, back, size, _) in enumerate(read_container(blob)[2]):
                    rows.append((i, k, kind, at, at - back, size))
                    at += size
            cols = list(zip(*rows)) if rows else [()] * 6
            where = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(where) for c in kept), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=[*kept, *(f.name for f in fields)])

    return containers.select(*kept, "container").mapInArrow(run, schema)


def decompress(containers: DataFrame, *, keep: Sequence[str] = ("stream_id",), digest_only: bool = False) -> DataFrame:
    """keep and data; with digest_only keep, md5 and xxh64 (seed 0, upper-case hex) instead."""
    kept = list(keep)
    fields = [T.StructField("md5", T.StringType()), T.StructField("xxh64", T.StringType())] if digest_only else [T.StructField("data", T.BinaryType())]
    schema = T.StructType([*containers.select(*kept).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if (x := c.as_py()) is None else decode_container(x) for c in b["container"]]
            if digest_only:
                cols = [pa.array([None if d is None else hashlib.md5(d).hexdigest() for d in data], pa.string()), pa.array([None if d is None else xxhash.xxh64_hexdigest(d, seed=0).upper() for d in data], pa.string())]
            else:
                cols = [pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *cols], names=[f.name for f in schema.fields])

    return containers.select(*kept, "container").mapInArrow(run, schema)


def write_containers(containers: DataFrame, path: str) -> None:
    """Parquet of stream_id and container; containers are whole cells, so each can be written to a file of its own by any reader."""
    containers.select("stream_id", "container", F.octet_length("container").alias("bytes")).write.mode("overwrite").parquet(path)


def write_container_files(containers: DataFrame, folder: str) -> DataFrame:
    """Each container as a file of its own in a folder that all executors share, named by a digest of its stream_id; stream_id, file and bytes.

    A file appears whole under its name or not at all, so a task that is run again does no harm.
    """
    schema = T.StructType([containers.schema["stream_id"], T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType())])
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes = [], []
            for stream, cell in zip(b["stream_id"].to_pylist(), b["container"]):
                blob = cell.as_py()
                if blob is None:
                    names.append(None)
                    sizes.append(None)
                    continue
                name = os.path.join(folder, hashlib.md5(str(stream).encode()).hexdigest() + ".cdc")
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                    f.write(blob)
                os.replace(f.name, name)
                names.append(name)
                sizes.append(len(blob))
            yield pa.RecordBatch.from_arrays([b["stream_id"], pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["stream_id", "file", "bytes"])

    return containers.select("stream_id", "container").mapInArrow(run, schema)


def read_container_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (the path) and container of container files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), F.col("content").alias("container"))
