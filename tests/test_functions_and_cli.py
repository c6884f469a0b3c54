import io
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chunkloom import cli
from chunkloom.functions.registry import register
from chunkloom.operators import chunking, resemblance
from chunkloom.sources import container, streams


def test_registered_functions(spark):
    names = register(spark)
    data = random.Random(1).randbytes(3_000)
    data = data[:1_000] + b"y" + data[1_001:]
    df = spark.createDataFrame([(1, data, data[:1_000] + b"x" + data[1_001:]), (2, None, b"")], "i int, a binary, b binary")
    df.createOrReplaceTempView("blobs")
    r = spark.sql(
        "SELECT chunk_cdc(a, 64, 256, 2048) c, chunk_fixed(a, 1000) f, chunk_two_stage(a, 64, 256, 2048) t, gear_hash(a) g, simhash64(a, 16) s, delta_encode(b, a, 16) d, common_prefix(a, b) p, common_suffix(a, b) x,"
        " container_decode(container_encode(a)) = a ok, vli_decode(vli_encode(300L)) v, xxh64_hex(b) h, xxh3_64(a) k, size(super_features(a)) sf, size(lz_plan(a)) n FROM blobs ORDER BY i"
    ).collect()
    assert [c.offset + c.size for c in r[0].c] == chunking.cdc_cuts(data) and [c.size for c in r[0].f] == [1000] * 3
    assert [c.offset + c.size for c in r[0].t] == chunking.two_stage_cuts(data)
    assert (r[0].p, r[0].x, r[0].ok, r[0].v, r[0].sf) == (1_000, 1_999, True, 300, 4)
    assert r[0].s & (2**64 - 1) == resemblance.simhash(data)[0] and sum(s.size for s in r[0].d) == 3_000
    assert r[1].c is None and r[1].ok is None and r[1].h == "EF46DB3751D8E999" and len(names) == 16


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.bin").write_bytes(os.urandom(100_000) * 2)
    out, back, trace = (str(tmp_path / n) for n in ("out", "back", "trace"))
    assert cli.main(["compress", str(source), out, "--dict", "1"], spark) == 0
    assert cli.main(["decompress", out, back], spark) == 0
    assert spark.read.parquet(back).first().data == (source / "a.bin").read_bytes()
    assert cli.main(["decompress", out, "hash"], spark) == 0
    assert cli.main(["test", str(source), "--trace-out", trace], spark) == 0
    assert cli.main(["test", str(source), "--trace-in", trace], spark) == 0
    assert cli.main(["test", str(source), "--two-stage", "--trace-in", trace], spark) == 1
    assert cli.main(["gear", str(source), "40"], spark) == 0
    assert "DER" in capsys.readouterr().out
    assert spark.read.parquet(out).select(F.sum("bytes")).first()[0] < 110_000


def test_container_files_and_standard_streams(spark, tmp_path, capsysbinary, monkeypatch):
    data = os.urandom(30_000) * 2
    source, files, back = tmp_path / "in.bin", str(tmp_path / "files"), str(tmp_path / "back")
    source.write_bytes(data)
    assert cli.main(["compress", str(source), files, "--files", "--delta", "shingling", "--features", "--sizes", "128", "512", "4096"], spark) == 0
    assert len(os.listdir(files)) == 1 and cli.main(["decompress", files, back, "--files"], spark) == 0
    assert spark.read.parquet(back).first().data == data
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(data)))
    capsysbinary.readouterr()
    assert cli.main(["compress", "-", "-", "--delta", "none"], spark) == 0
    blob = capsysbinary.readouterr().out
    assert len(blob) < 32_000 and container.decode_container(blob) == data
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.cdc").write_bytes(blob)
    assert cli.main(["decompress", str(tmp_path / "one"), "-", "--files"], spark) == 0
    assert capsysbinary.readouterr().out == data
    with pytest.raises(ValueError):
        cli.main(["compress", str(source), files, "--sizes", "1", "512", "4096"], spark)


def test_traces_by_position(spark):
    a = [(0, 5, 1), (5, 7, 2), (12, 4, 3)]
    frame = lambda rows: spark.createDataFrame([(o, s, Decimal(h)) for o, s, h in rows], streams.TRACE_SCHEMA)
    assert streams.trace_differences(frame(a), frame(a)).count() == 0
    got = streams.trace_differences(frame(a), frame([(0, 5, 1), (5, 9, 4)])).orderBy("place").collect()
    assert [(r.place, r.expected.offset, r.actual and r.actual.size) for r in got] == [(1, 5, 9), (2, 12, None)]


def test_super_features_meet_all_holders(spark):
    """Against the planner's index: every holder, but those that a later chunk matches in all four."""
    r = random.Random(2)
    rows = [(1, i, [r.randrange(3) for _ in range(4)]) for i in range(60)]
    index, want = {}, {}
    for _, i, sf in rows:
        counts = {}
        for key in enumerate(sf):
            for j in index.get(key, []):
                counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            want[i, j] = n
            if n == 4:
                for key in enumerate(sf):
                    index[key].remove(j)
        for key in enumerate(sf):
            index.setdefault(key, []).append(i)
    got = resemblance.sharing_features(spark.createDataFrame(rows, "stream_id long, chunk_i long, super_features array<long>")).collect()
    assert {(x.chunk_i, x.similar_i): x.shared for x in got} == want
