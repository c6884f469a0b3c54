"""Operators on Spark: against kernels, laws and a second engine."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chunkloom import queries as Q
from chunkloom.config import COMPRESS
from chunkloom.functions import bits
from chunkloom.operators import chunking, dedup, resemblance
from chunkloom.sources import container, streams
from chunkloom.streaming import chunks as streaming

CHUNKS = "stream_id long, chunk_i long, offset long, size long, hash string"


@pytest.fixture(scope="module")
def second(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_agrees_with_second_engine(spark, second, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in Q.ORACLES:
        assert rows
        return
    found = second.execute(Q.ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(rounded(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in sorted(cols)) for r in rows), key=repr) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(Q.ORACLES) <= set(Q.QUERIES)


@pytest.mark.parametrize("size", [31, 32, 333, 1000, 100_000])
def test_segments_do_not_change_cuts(spark, sf_dir, size):
    s = Q.streams(spark, sf_dir).filter("stream_id < 40")
    whole = chunking.cdc_chunks(s, digest=False)
    assert chunking.cuts_of_segments(chunking.segments(s, size)).exceptAll(whole).isEmpty()


def test_nulls_and_empty_streams(spark):
    s = spark.createDataFrame([(1, None), (2, b""), (3, b"abc"), (None, b"x" * 300)], "stream_id long, data binary")
    rows = chunking.cdc_chunks(s, with_data=True).collect()
    assert [(r.stream_id, r.size) for r in sorted(rows, key=lambda r: (r.stream_id is None, r.stream_id or 0))] == [(3, 3), (None, 300)]
    assert chunking.fixed_chunks(s, 256).count() == 3
    empty = s.limit(0)
    assert chunking.cdc_chunks(empty).count() == 0
    assert dedup.dedup_summary(chunking.cdc_chunks(empty)).first().asDict() == {"chunks": 0, "unique_chunks": 0, "total_bytes": 0, "dup_bytes": 0, "der": 1.0}
    back = {r.stream_id: r.data for r in container.decompress(container.compress(s)).collect()}
    assert back == {1: None, 2: b"", 3: b"abc", None: b"x" * 300}


def test_window_closed_form(spark):
    rows = [(1, i, 100 * i, 100, h) for i, h in enumerate("abacabba")]
    c = spark.createDataFrame(rows, CHUNKS)
    for limit in (100, 200, 400, 10_000):
        got = {r.chunk_i: r.prev_offset for r in dedup.latest_earlier(c, limit).collect()}
        for _, i, off, _, h in rows:
            earlier = [o for _, j, o, _, g in rows if j < i and g == h]
            assert got[i] == (max(earlier) if earlier and off - max(earlier) <= limit else None)


def test_corpus_offsets_over_many_pages(spark):
    df = spark.range(5_000).selectExpr("id * 3 AS k", "id % 7 AS n")
    got = [r.o for r in dedup.running_total(df, "k", "n", "o").orderBy("k").collect()]
    want, total = [], 0
    for i in range(5_000):
        want.append(total)
        total += i % 7
    assert got == want


def test_hamming_functions(spark):
    values = [0, 1, 2, 3, 5, -1, 1 << 62, -(1 << 63), 123456789012345]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for r in df.select("x", bits.hamming_syndrome(F.col("x")).alias("s"), bits.hamming_base(F.col("x")).alias("b"), bits.bit_reverse(F.col("x").bitwiseAND(255), 8).alias("r"), bits.trailing_zeros(F.col("x")).alias("z"), bits.leading_zeros(F.col("x")).alias("l")).collect():
        u = r.x & (2**64 - 1)
        syndrome = 0
        for k in range(64):
            syndrome ^= k if u >> k & 1 else 0
        assert r.s == syndrome and r.b & (2**64 - 1) == (u ^ (1 << syndrome)) & ~1
        assert r.r == int(f"{u & 255:08b}"[::-1], 2) and r.l == 64 - u.bit_length()
        assert r.z == (64 if u == 0 else (u & -u).bit_length() - 1)
    d = df.select(bits.hamming_distance(F.col("x"), F.lit(0).cast("long")).alias("d")).collect()
    assert [r.d for r in d] == [(v & (2**64 - 1)).bit_count() for v in values]


def test_vli_size_column(spark):
    values = [0, 127, 128, 16511, 16512, 2113663, 2113664, 270549119, 270549120, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(bits.vli_size(F.col("v")).alias("n"))
    assert [r.n for r in df.collect()] == [len(bits.vli_encode(v)) for v in values]


def test_traces_roundtrip(spark, tmp_path):
    rows = [(0, 300, 2**64 - 1), (300, 50, 7)]
    df = spark.createDataFrame([(a, b, str(h)) for a, b, h in rows], "offset long, size long, hash string")
    streams.write_trace(df, str(tmp_path / "t"))
    back = streams.read_trace(spark, str(tmp_path / "t"))
    assert [(r.offset, r.size, int(r.hash)) for r in back.orderBy("offset").collect()] == rows
    assert streams.compare_traces(back, back).isEmpty()
    assert streams.compare_traces(back, back.filter("offset = 0")).count() == 1


def test_files_to_containers_and_back(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(os.urandom(3_000) * (k + 1))
    s = streams.from_files(spark, str(tmp_path))
    c = container.compress(s)
    container.write_containers(c, str(tmp_path / "out"))
    back = container.decompress(spark.read.parquet(str(tmp_path / "out")))
    assert back.join(s, "stream_id").filter(back["data"] != s["data"]).isEmpty() and back.count() == 3
    total = container.instructions(c).groupBy("stream_id").agg(F.sum("size").alias("n")).join(s, "stream_id")
    assert total.filter("n <> n_bytes").isEmpty()


def test_similarity_kernels_find_edited_chunk(spark):
    data = os.urandom(1_000)
    edited = data[:500] + b"!" + data[501:]
    c = spark.createDataFrame([(1, 0, data), (1, 1, edited), (1, 2, os.urandom(1_000))], "stream_id long, chunk_i long, data binary")
    found = resemblance.with_similarity(c)
    pairs = resemblance.previous_similar(found, 4, 20).collect()
    assert [(r.chunk_i, r.similar_i) for r in pairs] == [(1, 0)]


def test_streaming_chunks_equal_batch_chunks(spark, sf_dir, tmp_path):
    s = Q.streams(spark, sf_dir).filter("stream_id < 12").withColumn("stream_id", F.col("stream_id").cast("string"))
    size = 700
    n = F.octet_length("data")
    parts = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))))
    parts = parts.select("stream_id", F.col("i").cast("long").alias("seg_idx"), F.substring("data", F.col("i") * size + 1, F.lit(size)).alias("data"), ((F.col("i") + 1) * size >= n).alias("is_last"))
    # Later segments come in an earlier file.
    parts.filter("seg_idx % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    parts.filter("seg_idx % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(streaming.SEGMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.chunk_stream(source).writeStream.format("memory").queryName("chunked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("chunked").select("stream_id", "chunk_i", "offset", "size", "hash")
    want = chunking.cdc_chunks(s, COMPRESS)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_streaming_duplicates_in_event_time(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=m), "a", "p") for i, m in enumerate([0, 1, 2, 600])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, props string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp, event_type string, props string").parquet(str(tmp_path / "in"))
    q = streaming.suppress_duplicates(source, ["event_type", "props"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("once").count() == 1
    counts = streaming.windowed_counts(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(r.n for r in counts) == [1, 3]
