import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm import packing, queries, shard

ROWS = [(i, "copy" if i % 3 else f"text {i}", "s") for i in range(997)] + [(None, None, None)] * 5 + [(7, "same", "s")] * 40 + [(8, "", "")]
SCHEMA = "doc_id long, text string, source string"


def test_shuffle_is_a_permutation_dealt_evenly(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = shard.external_shuffle(df, bucket_bytes=500, min_buckets=4).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15


def test_same_seed_same_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = lambda seed: {r.doc_id: (r.shard, r.slot) for r in shard.external_shuffle(df, seed=seed).select("doc_id", "shard", "slot").collect()}
    a = run(1)
    assert a == run(1) and a != run(2)


def test_offsets_over_pages(spark):
    counts = spark.range(3_000).selectExpr("id AS bucket", "id % 5 + 1 AS n")
    got = [r.before for r in shard.offsets(counts).orderBy("bucket").collect()]
    assert got == np.concatenate(([0], np.cumsum([i % 5 + 1 for i in range(2_999)]))).tolist()


def test_shard_files_and_query(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shard.write_shards(shard.external_shuffle(df, n_shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select(*df.columns).exceptAll(df).isEmpty()
    texts = {r.doc_id: r.text for r in df.collect()}
    got = queries.op10_external_shuffle(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_shuffle_of_nothing_and_clashes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shard.external_shuffle(df).count() == 0
    clash = spark.createDataFrame(ROWS, SCHEMA).withColumn("Slot", F.lit(-1)).withColumn("bucket", F.lit("x"))
    assert sorted(r.slot for r in shard.external_shuffle(clash, n_shards=1).collect()) == list(range(len(ROWS)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_laws(sizes):
    sizes = sorted(sizes, reverse=True)
    caps = (8, 16, 32, 64)
    bins, offsets, chosen = packing.best_fit(sizes, caps)
    held = defaultdict(list)
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes):
        held[b].append((o, s))
    for b, items in held.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at <= chosen[b] and not any(c < chosen[b] and c >= at for c in caps)  # the smallest that holds it
    assert sorted(held) == list(range(len(chosen)))


def test_best_fit_takes_the_tightest_bin():
    bins, _, chosen = packing.best_fit([60, 50, 14, 4], (64,))
    assert bins.tolist() == [0, 1, 1, 0] and chosen.tolist() == [64, 64]
    assert packing.best_fit([5], (8, 64))[2].tolist() == [8]


def test_every_token_is_packed_once(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 300, 513, 4_096, 4_097, 20_000]))) for i in range(200)] + [(None, "a b"), (3, "a b"), (3, "a b"), (500, None), (501, "  ")]
    got = packing.pack(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, bin_id int"), group=64).collect()
    total = Counter()
    for x in got:
        total[x.doc_id] += x.n_tokens
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split())
    assert total == want and {x.doc_id for x in got} == {i for i, _ in rows}
    held = defaultdict(list)
    for x in got:
        assert x.start == 4_096 * x.piece and (x.bin_id is None) == (x.n_tokens == 0)
        if x.bin_id is not None:
            held[x.bin_id].append(x)
    for items in held.values():
        assert len({x.capacity for x in items}) == 1 and items[0].capacity in packing.CAPACITIES
        items.sort(key=lambda x: x.offset)
        assert all(a.offset + a.n_tokens == b.offset for a, b in zip(items, items[1:])) and items[-1].offset + items[-1].n_tokens <= items[0].capacity
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_wastes_little(spark, sf_dir):
    got = queries.op4_best_fit(spark, sf_dir).filter("bin_id IS NOT NULL").groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("n")).agg(F.sum("n").alias("n"), F.sum("capacity").alias("c")).first()
    assert got.n / got.c > 0.97


def test_order_against_a_model(spark):
    """Every record's shard and slot by a plain version: scatter, Fisher-Yates each bucket, deal the whole order round."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()
    got = shard.external_shuffle(df, bucket_bytes=500, min_buckets=4).collect()
    n_buckets = max(4, -(-sum(len((t or "").encode()) for _, t, _ in ROWS) // 500))
    place = df.withColumn("o", F.monotonically_increasing_id())
    place = place.withColumn("b", F.pmod(F.xxhash64(F.lit(shard.SEED), "doc_id", "o"), F.lit(n_buckets))).collect()
    buckets = defaultdict(list)
    for r in sorted(place, key=lambda r: r.o):
        buckets[r.b].append((r.doc_id, r.text, r.source))
    order = []
    for b in sorted(buckets):
        order += [buckets[b][i] for i in np.random.Generator(np.random.PCG64([shard.SEED, b])).permutation(len(buckets[b]))]
    assert sorted(((r.slot * 16 + r.shard, (r.doc_id, r.text, r.source)) for r in got), key=lambda x: x[0]) == list(enumerate(order))


def test_a_text_larger_than_a_bucket_and_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(shard, "MAX_BUCKETS", 3)
    rows = [(1, "x" * 100_000, "s")] + [(i, "y", "s") for i in range(2, 60)]
    got = shard.external_shuffle(spark.createDataFrame(rows, SCHEMA), bucket_bytes=100).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows) and len({r.bucket for r in got}) <= 3


def naive_packing(items, caps, per_sequence=packing.PER_SEQUENCE):
    """items: (key, size), packed as the docstring says, looking at every open bin: the least room, the one filled last of equals."""
    caps, bins, out, clock = sorted(caps), [], {}, 0
    left = sum(s for _, s in items)
    for key, size in items:
        clock += 1
        open_ = [b for b in bins if b["room"] >= size]
        if open_:
            best = min(open_, key=lambda b: (b["room"], -b["last"]))
        else:
            cap = min((c for c in caps if c >= size), key=lambda c: ((c + per_sequence) / min(c, left), c))
            best = {"room": cap, "used": 0, "number": len(bins), "last": clock}
            bins.append(best)
        out[key] = (best["number"], best["used"])
        best["room"], best["used"], best["last"] = best["room"] - size, best["used"] + size, clock
        left -= size
    return {k: (n, at, min(c for c in caps if c >= bins[n]["used"])) for k, (n, at) in out.items()}


def test_packing_query_against_a_naive_one(spark, sf_dir):
    rows = queries.op4_best_fit(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = Counter(r.doc_id for r in rows)
    for i, text in texts.items():
        n = len([w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w])
        assert pieces[i] == max(1, -(-n // 4096)) and sum(r.n_tokens for r in rows if r.doc_id == i) == n
    groups = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            groups[r.bin_id >> 32].append(r)
    for number, held in groups.items():
        held.sort(key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        want = naive_packing([((r.doc_id, r.piece), r.n_tokens) for r in held], packing.CAPACITIES)
        assert {(r.doc_id, r.piece): (r.bin_id - (number << 32), r.offset, r.capacity) for r in held} == want
