import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import metric_join, queries, rabitq

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_join(rows, cosine=0.98):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links: dict = {i: set() for i, _, _ in rows if i is not None}
    for i, x, a in ok:
        for j, y, b in ok:
            if i != j and a == b and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def clusters(n=400, dims=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dims))
    x = centres[r.integers(0, 12, n)] + r.choice([0.02, 0.1, 1.0], (n, 1)) * r.standard_normal((n, dims))
    x[50:90] = x[50]  # copies
    x[100:140] = x[100] + 0.01 * r.standard_normal((40, dims))
    return [(int(i), [float(np.float32(v)) for v in row], int(l)) for i, row, l in zip(r.permutation(n), x, np.where(np.arange(n) < 300, 0, r.integers(0, 3, n)))]


@pytest.mark.parametrize(("cell", "block"), [(2048, 2048), (40, 30), (15, 400)])
def test_join_is_exact(spark, cell, block):
    rows = clusters() + [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [1.0] + [None] * 15, 0), (1005, [1.0] * 16, None), (1006, [1e30] * 16, 0), (1007, [1e-30] * 16, 0), (1008, [1.0, 2.0], 0)]
    got = metric_join.metric_join(spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash")), cell=cell, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_join(rows) and len(got) == len(rows)


@pytest.mark.parametrize("groups", [1, 2, 1_000])
def test_join_over_several_levels(spark, monkeypatch, groups):
    """Cells are divided again and again, a few of them at a time."""
    monkeypatch.setattr(metric_join, "GROUPS", groups)
    r = np.random.default_rng(9)
    centres = r.standard_normal((60, 8)) * [4, 4, 2, 2, 1, 1, 0.5, 0.5]
    x = centres[r.integers(0, 60, 900)] * r.uniform(0.5, 2, (900, 1)) + 0.1 * r.standard_normal((900, 8))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], i % 2) for i in range(900)]
    got = metric_join.metric_join(spark.createDataFrame(rows, SCHEMA), cell=20, block=64).collect()
    assert {g.vec_id: (g.n_links, g.component_id, g.kept) for g in got} == brute_join(rows)


def test_join_of_repeated_and_null_ids(spark):
    v = [1.0, 2.0]
    rows = [(5, v, 1), (5, v, 1), (7, v, 1), (None, v, 1), (9, [2.0, -1.0], 1)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in metric_join.metric_join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted([(5, 1, 5, True)] * 2 + [(7, 1, 5, False), (None, 0, None, None), (9, 0, 9, True)], key=repr)
    assert metric_join.metric_join(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_search(rows, k=10, every=20):
    ok = {i: np.array(v, float) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((ok[q] - x) ** 2).sum())), i) for i, x in ok.items() if i != q)[:k]
            out[q] = near
    return out


def test_search_with_copies_and_ties(spark):
    rows = clusters(600, 24) + [(10_000, None, 1), (10_020, [0.0] * 24, 1), (10_040, [float("inf")] * 24, 1)]
    got: dict = {}
    for r in rabitq.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, block=100, group=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want, found, total = brute_search(rows), 0, 0
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        found += len({i for _, i in near} & {i for _, i in got[q].values()})
        total += 10
        for k, (d, i) in got[q].items():
            assert k == 1 or got[q][k - 1] <= (d, i)
    assert found / total >= 0.97


def test_search_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got: dict = {}
    for r in queries.op5_rabitq(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_search(rows, every=100)
    assert sum(len({i for _, i in near} & got[q]) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.5], 1), (3, [1.0, 2.0, 3.0], 1)]
    got = rabitq.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 0.5), (2, 1, math.sqrt(2))]
    assert rabitq.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert rabitq.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 99).count() == 0


def test_estimates_stay_within_bounds():
    r = np.random.default_rng(2)
    x = r.standard_normal((2_000, 64))
    centre, turn = x.mean(axis=0), rabitq.rotation(64)
    bits, norm, f = rabitq.encode(x, centre, turn)
    assert bits.shape == (2_000, 8)
    packed = rabitq.words(bits)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    for q in r.standard_normal((5, 64)):
        y = (q - centre) @ turn
        inner, variance = rabitq.products(y / np.linalg.norm(y), packed, ones)
        signs = (np.unpackbits(bits, axis=1) * 2.0 - 1) / 8
        assert np.abs(inner - signs @ (y / np.linalg.norm(y))).max() <= 6 * np.sqrt(variance)
        low, middle = rabitq.bounds(q, packed, ones, norm, f, centre, turn, rabitq.EPS)
        true = ((x - q) ** 2).sum(axis=1)
        assert (low <= true).mean() > 0.95 and (true <= 2 * middle - low).mean() > 0.95 and abs((middle - true).mean()) < 0.02 * true.mean()


def test_words_are_filled_up():
    bits = np.packbits(np.array([[1, 0, 1] * 25]), axis=1)  # 75 bits
    packed = rabitq.words(bits)
    assert packed.shape == (1, 2) and int(np.bitwise_count(packed).sum()) == 50


def test_search_in_many_cells(spark, monkeypatch):
    """Several cells, blocks and groups; clashing extra columns, a null id, a query that is copied."""
    monkeypatch.setattr(rabitq, "CELL", 40)
    rows = clusters(600, 24) + [(None, [0.1] * 24, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("k1", "dims", "_query", "cell", "code")})
    got: dict = {}
    for r in rabitq.nearest(df, F.col("vec_id") % 20 == 0, block=100, group=7).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r.score))
    want = brute_search([r for r in rows if r[0] is not None])
    assert got.keys() == want.keys()
    assert sum(len({i for _, i in near} & {i for i, _ in got[q]}) for q, near in want.items()) >= 0.97 * 10 * len(want)


def test_each_vector_length_is_searched(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=16 if i % 3 else 8).astype(np.float32).tolist(), 0) for i in range(90)]
    lone = [(90, [1.0, 2.0, 3.0], 0)]  # no other row of its length
    got = {}
    for x in rabitq.nearest(spark.createDataFrame(rows + lone, SCHEMA), F.col("vec_id").isin(*range(6), 90), k=4).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.vec_id
    assert sorted(got) == list(range(6))
    for q in range(6):
        v = np.array(rows[q][1])
        near = sorted((float(np.linalg.norm(v - np.array(w))), i) for i, w, _ in rows if i != q and len(w) == len(v))
        assert [got[q][k] for k in range(1, 5)] == [i for _, i in near[:4]]
