"""Byte-level kernels against plain models and their own laws."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import COMPRESS, LARGE, ChunkConfig, PlanConfig, checked
from chunkloom.functions import bits, gear
from chunkloom.operators import chunking, delta, resemblance
from chunkloom.plans import lz
from chunkloom.plans.lz import encode_stream
from chunkloom.sources.container import MAGIC, decode_container, read_container, write_container
from chunkloom.streaming.chunks import Chunker

CONFIGS = [COMPRESS, COMPRESS.with_(normalized=False), COMPRESS.with_(backup=False), COMPRESS.with_(normalized=False, backup=False), LARGE]


def model(data: bytes, cfg: ChunkConfig) -> list[int]:
    """The cut rule, byte by byte."""
    table, h, x = gear.gear_table(), [], 0
    for b in data:
        x = ((x << 1) + int(table[b])) & 0xFFFFFFFF
        h.append(x)
    n, p, out = len(data), 0, []
    hard, easy = ("hard", "easy") if cfg.normalized else ("medium", "medium")

    def first(low: int, high: int, kind: str) -> int | None:
        return next((i for i in range(low, high) if h[i] < cfg.threshold(kind)), None)

    while p < n:
        cut = first(p + cfg.min_size, min(p + cfg.avg_size, n), hard)
        cut = first(p + cfg.avg_size, min(p + cfg.max_size, n), easy) if cut is None else cut
        if cut is None and n - p < cfg.max_size:
            cut = n
        if cut is None and cfg.backup:
            cut = first(p + cfg.avg_size, p + cfg.max_size, "backup")
        p = p + cfg.max_size if cut is None else cut
        out.append(p)
    return out


def sample(kind: int, n: int, seed: int = 1) -> bytes:
    r = random.Random(seed)
    return bytes(7 if kind == 0 else r.choice(b"ab") if kind == 1 else r.randrange(256) for _ in range(n))


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 256, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_cuts_follow_the_rule(cfg, n, kind):
    data = sample(kind, n)
    cuts = chunking.cdc_cuts(data, cfg)
    assert cuts == model(data, cfg)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(sizes) == n and all(cfg.min_size <= s <= cfg.max_size for s in sizes[:-1])


def test_two_stage_cuts_respect_sizes():
    for kind in (0, 1, 2):
        data = sample(kind, 20_000)
        cuts = chunking.two_stage_cuts(data)
        sizes = [b - a for a, b in zip([0, *cuts], cuts)]
        assert cuts[-1] == len(data) and all(COMPRESS.min_size <= s <= COMPRESS.max_size for s in sizes[:-1]) and sizes[-1] <= COMPRESS.max_size
    assert chunking.two_stage_cuts(b"") == []


@pytest.mark.parametrize("size", [1, 3_000, 1 << 20])
def test_streams_cut_together_as_alone(monkeypatch, size):
    monkeypatch.setattr(chunking, "HASHED_AT_ONCE", size)
    parts = [sample(k % 3, n, n) for k, n in enumerate([5_000, 1, 64, 3_000, 2_048, 700, 9_000, 31])]
    assert list(chunking.cdc_cuts_of(parts)) == [chunking.cdc_cuts(p) for p in parts]
    assert list(chunking.two_stage_cuts_of(parts)) == [chunking.two_stage_cuts(p) for p in parts]
    assert list(chunking.cdc_cuts_of([])) == []


def test_edits_are_local():
    data = sample(2, 50_000)
    a, b = chunking.cdc_cuts(data), chunking.cdc_cuts(data[:20_000] + b"x" + data[20_000:])
    assert len(set(a[-50:]) & {c - 1 for c in b}) >= 45


def test_gear_windows_forget_after_32_bytes():
    a, b = gear.gear_hashes(sample(2, 500, 1) + sample(2, 200, 3)), gear.gear_hashes(sample(2, 500, 2) + sample(2, 200, 3))
    assert (a[531:] == b[531:]).all() and (a[500:510] != b[500:510]).any()


def test_gear_table_from_file(tmp_path):
    f = tmp_path / "table.txt"
    f.write_text(", ".join(map(str, range(256))))
    assert gear.gear_table(str(f))[255] == 255
    f.write_text("1 2 3")
    with pytest.raises(ValueError):
        gear.gear_table.__wrapped__(str(f))


def test_sizes_are_checked():
    checked(COMPRESS)
    with pytest.raises(ValueError):
        checked(ChunkConfig(32, 256, 2048))
    with pytest.raises(ValueError):
        ChunkConfig(256, 64, 2048)


@pytest.mark.parametrize(("v", "n"), [(0, 1), (127, 1), (128, 2), (16511, 2), (16512, 3), (2113663, 3), (2113664, 4), (2**63 - 1, 9)])
def test_vli_bounds(v, n):
    assert len(bits.vli_encode(v)) == n and bits.vli_decode(bits.vli_encode(v)) == (v, n)


@given(st.integers(0, 2**63 - 1), st.binary(max_size=5))
def test_vli_roundtrip(v, rest):
    coded = bits.vli_encode(v)
    assert bits.vli_decode(b"\x00" + coded + rest, 1) == (v, 1 + len(coded))


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_common_ends(a, b):
    p, s = bits.common_prefix(a, b), bits.common_suffix(a, b)
    assert a[:p] == b[:p] and (p == min(len(a), len(b)) or a[p] != b[p])
    assert (not s or a[-s:] == b[-s:]) and (s == min(len(a), len(b)) or a[-s - 1] != b[-s - 1])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 30), st.booleans())
def test_deltas_restore(seed, edits, content_defined):
    r = random.Random(seed)
    source = sample(1, r.randrange(1, 1500), seed)
    target = bytearray(source)
    for _ in range(edits):
        at = r.randrange(len(target) + 1)
        target[at : at + r.randrange(3)] = bytes(r.randrange(256) for _ in range(r.randrange(4)))
    steps = delta.delta(bytes(target), source, 16, content_defined)
    assert delta.apply_delta(steps, bytes(target), source) == bytes(target)
    assert sum(n for _, _, n in steps) == len(target) >= delta.saving(steps)


PLANS = [
    PlanConfig(), PlanConfig(delta=None), PlanConfig(delta="shingling", exhaustive_adjacency=True), PlanConfig(dictionary=4_000), PlanConfig(dictionary=4_000, lz77=False),
    PlanConfig(generalized=True, window=4, features=True, try_all=True), PlanConfig(extend_forward=False, extend_back=False, omit_below=0, adjacency=False, adjacency_back=False),
]


@pytest.mark.parametrize("cfg", PLANS)
def test_streams_roundtrip(cfg):
    a, b = sample(2, 6_000, 1), sample(2, 3_000, 2)
    edited = bytearray(a)
    for i in range(100, 6_000, 500):
        edited[i] ^= 1
    for data in (b"", b"x", b"a" * 5_000, a, a + a, a + b + a, a + bytes(edited), sample(1, 8_000), a[:2_000] * 4):
        steps, stats = encode_stream(data, cfg)
        assert sum(n for _, _, n in steps) == len(data) == stats["total_bytes"]
        blob = write_container(data, steps, cfg.dictionary, cfg.lz77)
        assert decode_container(blob) == data
        assert read_container(blob)[:2] == (cfg.dictionary or 0, cfg.lz77)
    assert len(write_container(a + a, encode_stream(a + a, PlanConfig())[0])) < 1.05 * len(a)


def test_savings_of_duplicates_are_those_of_the_whole_plan():
    """A short copy of a duplicate may be dropped by what follows it; what is counted is what the plan copies in the end."""
    words = ["Is", "heinon", "oubleon", "an", "the.", "Anntan", "rely.", "Esblely"]
    dropped = " ".join(w for w in words for _ in range(28)).encode()
    a, b = sample(2, 6_000, 1), sample(2, 3_000, 2)
    for cfg in PLANS:
        for data in (dropped, a[:2_000] * 4, a + b + a, b"a" * 5_000, dropped + a + dropped):
            steps, stats = encode_stream(data, cfg)
            cuts, seen, duplicate = chunking.cdc_cuts(data, cfg.chunks), set(), bytearray(len(data))
            for x, y in zip([0, *cuts], cuts):
                if data[x:y] in seen:
                    duplicate[x:y] = b"\x01" * (y - x)
                seen.add(data[x:y])
            copied = b"".join((b"\x01" if kind == delta.COPY else b"\x00") * n for kind, _, n in steps)
            if cfg.dictionary is None:
                assert stats["deduped_bytes"] == sum(x & y for x, y in zip(duplicate, copied))
            assert stats["deduped_bytes"] <= stats["dup_bytes"] and stats["deduped_bytes"] <= stats["saved_bytes"]
    stats = encode_stream(dropped, PlanConfig())[1]
    assert (stats["dup_bytes"], stats["deduped_bytes"], stats["saved_bytes"]) == (70, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"abc" * 200, b"xyz" * 333, b"\x00" * 500, b"Q" * 70, b"hello world " * 90]), max_size=12))
def test_repetitive_streams_roundtrip(parts):
    data = b"".join(parts)
    steps, _ = encode_stream(data, PlanConfig())
    assert decode_container(write_container(data, steps)) == data


def test_copies_may_overlap_themselves():
    assert decode_container(MAGIC + bytes(9) + b"\x01\x02ab" + b"\x00\x05\x02") == b"abababa"


@pytest.mark.parametrize("blob", [b"nope", MAGIC + bytes(9) + b"\x02\x01", MAGIC + bytes(9) + b"\x00\x01\x01"])
def test_broken_containers_are_refused(blob):
    with pytest.raises(ValueError):
        decode_container(blob)


def test_simhash_majority_and_ties():
    assert resemblance.simhash_of([]) == 0
    assert resemblance.simhash_of([0b1100, 0b1010, 0b1001]) == 0b1000
    assert resemblance.simhash_of([1, 0]) == 0
    assert resemblance.simhash_of([2**64 - 1] * 300) == 2**64 - 1


def test_older_holders_of_a_super_feature_are_tried(monkeypatch):
    """Every chunk shares three super-features with every other one: the nearest is not the latest."""
    r = random.Random(21)
    first, other = r.randbytes(20_000), r.randbytes(20_000)
    changed = bytearray(first)
    for at in range(500, len(changed), 997):
        changed[at] ^= 0x5A
    data = first + other + bytes(changed)
    serial = iter(range(10**6))
    monkeypatch.setattr(lz, "features", lambda part: [1])
    monkeypatch.setattr(lz, "super_features", lambda f: [1, 2, 3, 4 + next(serial)])
    steps, stats = encode_stream(data, PlanConfig(chunks=LARGE, features=True, adjacency=False, adjacency_back=False, extend_forward=False, extend_back=False, max_distance=20))
    assert stats["delta_chunks"] > 0 and decode_container(write_container(data, steps)) == data


def test_chunks_matched_in_all_super_features_leave_the_index(monkeypatch):
    r = random.Random(22)
    data = r.randbytes(100_000)
    tried = []
    monkeypatch.setattr(lz, "features", lambda part: [1])
    monkeypatch.setattr(lz, "super_features", lambda f: [1, 2, 3, 4])
    monkeypatch.setattr(lz, "simhash", lambda part, *_: tried.append(1) or [len(tried)])
    _, stats = encode_stream(data, PlanConfig(features=True, adjacency=False, adjacency_back=False))
    assert len(tried) == stats["unique_chunks"] > 100  # each chunk once: only the one before it was left


def test_another_gear_table(spark, tmp_path):
    """Cuts of every kind follow the table that the configuration brings."""
    r = random.Random(31)
    numbers = [r.getrandbits(32) for _ in range(256)]
    (tmp_path / "gear.txt").write_text(", ".join(map(str, numbers)))
    cfg = COMPRESS.with_(gear=gear.load_table(str(tmp_path / "gear.txt")))
    data = r.randbytes(60_000)

    def hash_at(i):
        return sum(numbers[data[i - k]] << k for k in range(min(32, i + 1))) & 0xFFFFFFFF

    cuts = chunking.cdc_cuts(data, cfg)
    assert cuts != chunking.cdc_cuts(data) and all(c == len(data) or c - b == cfg.max_size or hash_at(c) < cfg.easiest for b, c in zip([0, *cuts], cuts))
    df = spark.createDataFrame([(1, data)], "stream_id long, data binary")
    assert [x.offset + x.size for x in chunking.cdc_chunks(df, cfg).orderBy("offset").collect()] == cuts
    assert [x.offset + x.size for x in chunking.cuts_of_segments(chunking.segments(df, 7_000), cfg).orderBy("offset").collect()] == cuts
    chunker = Chunker(cfg, None)
    assert [c[1] + c[2] for i in range(0, 60_000, 7_000) for c in chunker.push(i // 7_000, data[i : i + 7_000], i + 7_000 >= 60_000)] == cuts
    assert decode_container(write_container(data, encode_stream(data, PlanConfig(chunks=cfg))[0])) == data
    with pytest.raises(ValueError):
        COMPRESS.with_(gear=(1, 2))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.integers(0, 63)), max_size=30))
def test_bits_written_are_read(items):
    w = bits.BitWriter()
    for v, n in items:
        w.put(v, n)
        w.put_reversed(v, n)
        w.fill_byte()
        w.put_vli(v)
    r = bits.BitReader(w.bytes())
    for v, n in items:
        low = v & ((1 << n) - 1)
        assert r.peek(n) == low and r.get(n) == low and r.get_reversed(n) == low
        r.get(-r.position % 8)
        assert r.get_vli() == v
    assert r.left == 0 and r.get(5) == 0
    with pytest.raises(ValueError):
        r.get_vli()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 400))
def test_bytes_shared_before_two_places(part, a, b, most):
    data = part * 9
    a, b = min(a * 7, len(data)), min(b * 9, len(data))
    most = min(most, a, b)
    want = next((k for k in range(most) if data[a - 1 - k] != data[b - 1 - k]), most)
    assert lz.shared_before(data, a, b, most) == want


def test_a_copy_goes_on_into_the_next_one():
    """The copy before takes what it can of a copy that cannot grow back over it."""
    head, tail = b"0123456789abcdefghij", b"KLMNOPQRSTUVWXYZ"
    data = head + b"KLM" + b"#" * 9 + tail + b"*" * 5 + head + tail
    plan = lz.Plan(data, PlanConfig(omit_below=0))
    at = len(data) - len(head + tail)
    plan.add("INSERT", 0, at)
    plan.add("COPY", 0, len(head))
    plan.add("COPY", data.index(tail), len(tail))
    assert plan.steps == [("INSERT", 0, at), ("COPY", 0, len(head) + 3), ("COPY", data.index(tail) + 3, len(tail) - 3)]
    assert decode_container(write_container(data, plan.steps)) == data
