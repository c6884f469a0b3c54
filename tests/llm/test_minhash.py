import random

import numpy as np
import pytest

from chunkloom.llm import components as cc
from chunkloom.llm import minhash
from chunkloom.llm._common import Scratch

SCHEMA = "doc_id long, text string"


def sets(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    comp = {i: i for i in s}
    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                n = len(s[a] & s[b])
                if 100 * n >= 75 * (len(s[a]) + len(s[b]) - n) and comp[a] != comp[b]:
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(s[i]), comp[i], comp[i] == i) for i in s}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(40):
        base = [word() for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 12)):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out += [" ".join(base).upper()] * r.randrange(3)
    passage = " ".join(word() for _ in range(60))
    out += [passage + " " + " ".join(word() for _ in range(100)) for _ in range(50)]
    out += ["", "   ", "\t\n", "one two", "ONE  two", "one two three four five", "é É", "a\u00a0b c", "x" * 50_000, "w " * 30_000]
    r.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)] + [(9_999, None)]


@pytest.mark.parametrize("options", [{}, {"block": 5, "region": 8}, {"trees": 40, "block": 3, "grid": 6}])
def test_components_against_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", group string")
    got = minhash.near_duplicates(df, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows) and len(got) == len(rows)


def test_one_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        copy = list(base)
        copy[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(600 + i, " ".join(base)) for i in range(600)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.component_id for x in got} == {0} and sum(x.kept for x in got) == 1


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(4, text), (4, text), (2, text), (None, text), (7, None), (8, "a b c d e f"), (8, text)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(4, 4, 2, False)] * 2 + [(2, 4, 2, True), (None, 4, None, None), (7, 0, 7, True), (8, 2, 2, False), (8, 4, 2, False)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlaps_against_sets(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(1)
    sets_ = [np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    got = minhash.overlaps(sets_[:8], sets_[8:])
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets_[8:]] for x in sets_[:8]]
    assert minhash.overlaps([], sets_).shape == (0, 20) and minhash.spanning_links([sets_[0]], None, 75) == []


def test_thresholds_are_exact():
    a = np.arange(100, dtype=np.uint64)
    assert minhash.linked(a, a[:75]) and not minhash.linked(a, a[:74]) and not minhash.linked(a[:0], a[:0])
    assert minhash.linked(a[:3], a[:4]) and not minhash.linked(a[:2], a[:3])


@pytest.mark.parametrize("limit", [10**6, 300])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(cc, "LOCAL_EDGES", limit)
    r = np.random.default_rng(0)
    a = np.concatenate([np.arange(1500), r.integers(5_000, 9_000, 1500), np.full(800, 20_000)])
    b = np.concatenate([np.arange(1, 1501), r.integers(5_000, 9_000, 1500), 20_001 + np.arange(800)])
    ids, root = cc.roots(a, b)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    got = {x.id: x.component for x in cc.components(df, Scratch(spark, "t")).collect()}
    loops = {x for x in set(a.tolist()) if x not in got}
    assert got == {i: c for i, c in zip(ids.tolist(), root.tolist()) if i not in loops}


def edited(n, least, most, seed=3, size=200):
    """n texts of one base with some words replaced."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(size)]
    for i in range(n):
        copy = list(base)
        for k in r.sample(range(size), r.randint(least, most)):
            copy[k] = f"x{i}y{k}"
        yield i, " ".join(copy)


def exact_components(rows):
    """Links by products of membership matrices over all pairs."""
    held = [minhash.shingles(t) for _, t in rows]
    size = np.array([len(s) for s in held])
    a, b = [], []
    for s in range(0, len(rows), 500):
        n = minhash.overlaps(held[s : s + 500], held)
        i, j = np.nonzero(100 * n >= 75 * (size[s : s + 500, None] + size[None, :] - n))
        a.append(i[i + s < j] + s)
        b.append(j[i + s < j])
    ids, root = cc.roots(np.concatenate(a), np.concatenate(b))
    return {i: i for i, _ in rows} | dict(zip(ids.tolist(), root.tolist())), sum(map(len, a))


@pytest.mark.parametrize("partitions", ["8", "64"])
def test_six_thousand_near_copies(spark, partitions):
    """One dense group beyond the grid, with the default options: all of its links, whatever the number of partitions."""
    rows = list(edited(6_000, 5, 7))
    want, links = exact_components(rows)
    assert links > 500
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want


def test_large_groups_miss_no_link(spark, monkeypatch):
    """A dense region far over window, region and grid, with links that no neighbour in an order shows."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(164)]
    rows = []
    for _ in range(120):
        base = passage + [word() for _ in range(28)]
        rows.append(" ".join(base))
        rows.append(" ".join(base[:-25] + [word() for _ in range(25)]))  # just over the threshold, all others just below
    rows = list(enumerate(rows))
    r.shuffle(rows)
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) == 120
    for cost in (0, 40):  # pair by pair, and by blocks
        monkeypatch.setattr(minhash, "PAIR_COST", cost)
        monkeypatch.setattr(minhash, "LARGE_BLOCK", 50)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), region=8, window=1, block=8, grid=16).collect()
        assert {d.doc_id: (d.n_shingles, d.component_id, d.kept) for d in got} == want


def test_linked_sets_share_a_rare_shingle():
    r = random.Random(12)
    frequent = np.array(sorted(r.sample(range(1000), 200)), np.uint64)
    counts = np.array([r.randrange(3, 9) for _ in frequent], np.int64)
    links = 0
    for _ in range(3000):
        x = r.sample(range(1000), r.randrange(1, 40))
        y = list({*r.sample(x, max(1, round(len(x) * r.uniform(0.7, 1)))), *r.sample(range(1000), r.randrange(6))})
        x, y = (np.array(sorted(z), np.uint64) for z in (x, y))
        if minhash.linked(x, y):
            links += 1
            assert set(minhash.rarest(x, frequent, counts, 75).tolist()) & set(minhash.rarest(y, frequent, counts, 75).tolist())
    assert links > 300
