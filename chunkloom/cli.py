"""Command line: compress files, restore them, compare chunkings, look a hash up.

python -m chunkloom.cli compress IN OUT [options]       containers of the files of a folder or pattern (IN "-": of standard input), as Parquet
python -m chunkloom.cli compress IN OUT --files         the same, each container in a file of its own; OUT "-": one container to standard output
python -m chunkloom.cli decompress IN OUT [--files]     the streams again, as Parquet; OUT "hash": digests to the console; "-": one stream to standard output
python -m chunkloom.cli test IN [--two-stage] [--trace-out DIR] [--trace-in DIR]    chunk statistics; traces of one file's chunks
python -m chunkloom.cli gear IN POSITION                the rolling hash at a position of each file
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkloom import ensure_importable
from chunkloom.config import COMPRESS, LARGE, ChunkConfig, PlanConfig, checked
from chunkloom.functions.gear import binary_digits, gear_at, load_table
from chunkloom.functions.registry import register
from chunkloom.operators import chunking, dedup
from chunkloom.sources import container, streams


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--dict", type=int, default=None, help="MiB that copies may reach back")
    c.add_argument("--files", action="store_true")
    c.add_argument("--delta", choices=["none", "shingling", "minichunks"], default="minichunks", help="parts by which similar chunks are matched")
    c.add_argument("--features", action="store_true", help="find similar chunks by super-features")
    c.add_argument("--generalized", action="store_true", help="find similar chunks by hamming bases")
    c.add_argument("--window", type=int, default=0, help="find similar chunks among so many before")
    c.add_argument("--sizes", type=int, nargs=3, metavar=("MIN", "AVG", "MAX"), help="bytes of a chunk")
    c.add_argument("--gear", help="file of 256 numbers for the rolling hash")
    d = sub.add_parser("decompress")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--files", action="store_true")
    t = sub.add_parser("test")
    t.add_argument("source")
    t.add_argument("--two-stage", action="store_true")
    t.add_argument("--trace-out")
    t.add_argument("--trace-in")
    g = sub.add_parser("gear")
    g.add_argument("source")
    g.add_argument("position", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("chunkloom").getOrCreate()
    ensure_importable(spark)
    if args.command == "decompress":
        stored = container.read_container_files(spark, args.source) if args.files else spark.read.parquet(args.source)
        if args.target == "-":
            sys.stdout.buffer.write(_only(container.decompress(stored), "data"))
        elif args.target == "hash":
            container.decompress(stored, digest_only=True).show(100, truncate=False)
        else:
            container.decompress(stored).write.mode("overwrite").parquet(args.target)
        return 0
    files = streams.from_reader(spark, sys.stdin.buffer) if args.source == "-" else streams.from_files(spark, args.source)
    if args.command == "compress":
        chunks = ChunkConfig(*args.sizes) if args.sizes else COMPRESS
        chunks = checked(chunks.with_(gear=load_table(args.gear)) if args.gear else chunks)
        cfg = PlanConfig(chunks=chunks, dictionary=args.dict << 20 if args.dict else None, delta=None if args.delta == "none" else args.delta, features=args.features, generalized=args.generalized, window=args.window)
        made = container.compress(files, cfg)
        if args.target == "-":
            sys.stdout.buffer.write(_only(made, "container"))
        elif args.files:
            container.write_container_files(made, args.target).write.format("noop").mode("overwrite").save()
        else:
            container.write_containers(made, args.target)
    elif args.command == "gear":
        at = F.lit(args.position)
        files.select("stream_id", gear_at(F.col("data"), at).alias("gear")).withColumn("digits", binary_digits(F.col("gear"))).show(100, truncate=False)
    else:
        began = time.time()
        cut = chunking.two_stage_chunks if args.two_stage else chunking.cdc_chunks
        chunks = cut(files, LARGE, with_data=True)
        row = dedup.dedup_summary(chunks).first()
        seconds = time.time() - began
        print(f"chunks {row['chunks']}, unique {row['unique_chunks']}, bytes {row['total_bytes']}, duplicate {row['dup_bytes']}, DER {row['der']}, {row['total_bytes'] / 2**20 / seconds:.1f} MiB/s")
        if args.trace_out or args.trace_in:
            register(spark)
            # Traces hold unsigned 64-bit hashes.
            hashed = chunks.withColumn("hash", F.expr("xxh3_64(data)").cast("decimal(20,0)"))
            trace = hashed.select("offset", "size", F.when(F.col("hash") < 0, F.col("hash") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(F.col("hash")).cast("decimal(20,0)").alias("hash"))
            if args.trace_out:
                streams.write_trace(trace, args.trace_out)
            if args.trace_in:
                differing = streams.compare_traces(streams.read_trace(spark, args.trace_in), trace)
                if not differing.isEmpty():
                    differing.show(20, truncate=False)
                    return 1
    return 0


def _only(rows, column: str) -> bytes:
    """The cell of the only row."""
    found = rows.select(column).limit(2).collect()
    if len(found) != 1:
        raise SystemExit("standard output takes one stream")
    return bytes(found[0][0])


if __name__ == "__main__":
    sys.exit(main())
