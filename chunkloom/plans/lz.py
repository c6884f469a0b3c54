"""The copy/insert plan of a whole stream: duplicate lookup, deltas against similar chunks, and the optimised instruction list.

The plan is a fold: what a chunk is coded from depends on what the one before was. A stream is folded in one pass by
`encode_stream`; streams are independent rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

from chunkloom.config import PlanConfig
from chunkloom.functions.bits import common_prefix, common_suffix
from chunkloom.operators.chunking import cdc_cuts
from chunkloom.operators.delta import COPY, INSERT, Step, delta, saving
from chunkloom.operators.resemblance import features, simhash, super_features


def shared_before(data: bytes, a: int, b: int, most: int) -> int:
    """Bytes, at most so many, that agree before two places."""
    done, step = 0, 64
    while done < most:
        n = min(step, most - done)
        same = common_suffix(data[a - done - n : a - done], data[b - done - n : b - done])
        done += same
        if same < n:
            break
        step *= 4
    return done


class Plan:
    """Instructions (type, source offset, size) that cover a stream's prefix; sources are offsets in the stream."""

    def __init__(self, data: bytes, cfg: PlanConfig):
        self.data, self.cfg = data, cfg
        self.steps: list[Step] = []
        self.end = 0
        self.extended_forward = self.extended_back = self.omitted = 0

    def add(self, kind: str, source: int, size: int, earliest: int = 0) -> None:
        """Append an instruction for the next `size` bytes; copies read from `earliest` on."""
        cfg, steps, start = self.cfg, self.steps, self.end
        self.end += size
        if steps and steps[-1][0] == kind and steps[-1][1] + steps[-1][2] == source:
            k, at, n = steps[-1]
            steps[-1] = (k, at, n + size)
            return
        if steps and steps[-1][0] == COPY and cfg.extend_forward:
            # The copy before may go on into this one, where that swallows it or nothing grows back.
            _, at, n = steps[-1]
            ahead = min(common_prefix(self.data[at + n : at + n + size], self.data[start : start + size]), size)
            if ahead == size or ahead and (kind == INSERT or not cfg.extend_back or shared_before(self.data, source, start, min(n, source - earliest)) < n):
                steps[-1] = (COPY, at, n + ahead)
                if kind == INSERT:
                    self.extended_forward += ahead
                source, size, start = source + ahead, size - ahead, start + ahead
                if not size:
                    return
        if kind == COPY and cfg.extend_back:
            while steps:
                k, at, n = steps[-1]
                # Compare backwards from both places, not before what may be read.
                reach = min(n, source - earliest)
                grown = shared_before(self.data, source, start, reach)
                if grown == n:
                    steps.pop()
                elif k == INSERT and grown:
                    steps[-1] = (k, at, n - grown)
                else:
                    break
                if k == INSERT:
                    self.extended_back += grown
                source, size, start = source - grown, size + grown, start - grown
                if grown < n:
                    break
        if kind == INSERT and steps and steps[-1][0] == COPY and steps[-1][2] < cfg.omit_below:
            n = steps.pop()[2]
            self.omitted += n
            source, size = start - n, size + n
            if steps and steps[-1][0] == INSERT and steps[-1][1] + steps[-1][2] == source:
                k, at, n = steps.pop()
                source, size = at, size + n
        steps.append((kind, source, size))

    def take_back(self, size: int) -> None:
        """Forget the instructions of the last `size` bytes."""
        self.end -= size
        while size:
            kind, at, n = self.steps.pop()
            if n > size:
                self.steps.append((kind, at, n - size))
            size -= min(n, size)

    def copied(self, spans: list[tuple[int, int]]) -> int:
        """Bytes of the spans (start, end; in order, apart) that copies make."""
        done, k, at = 0, 0, 0
        for kind, _, n in self.steps:
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            j = k
            while kind == COPY and j < len(spans) and spans[j][0] < at + n:
                done += min(at + n, spans[j][1]) - max(at, spans[j][0])
                j += 1
            at += n
        return done


def encode_stream(data: bytes, cfg: PlanConfig) -> tuple[list[Step], dict[str, int]]:
    """Plan and statistics of one stream."""
    cuts = cdc_cuts(data, cfg.chunks)
    starts = [0, *cuts[:-1]]
    n = len(cuts)
    plan = Plan(data, cfg)
    stats = dict.fromkeys(("chunks", "unique_chunks", "dup_bytes", "deduped_bytes", "delta_chunks", "delta_bytes"), 0)
    stats["chunks"] = n
    part = lambda i: data[starts[i] : cuts[i]]
    known: dict[bytes, list[int]] = {}
    hashes: list[bytes] = []
    lsh: dict[int, int] = {}
    bases: dict[int, int] = {}
    index: dict[tuple[int, int], dict[int, None]] = {}  # all chunks with a super-feature, but those that a later one matches in all
    unreduced = set()  # chunks that are plain inserts, for walking back
    duplicates: list[tuple[int, int]] = []
    anchor: int | None = None  # match of the chunk before
    used_before = [0] * (n + 1)  # bytes of first instances before each chunk, where duplicates take no room

    def distance_back(i: int, j: int) -> int:
        return starts[i] - starts[j] if cfg.lz77 else used_before[i] - used_before[j]

    def usable(i: int, j: int) -> bool:
        return 0 <= j < i and (cfg.dictionary is None or distance_back(i, j) <= cfg.dictionary)

    def similar_hash(i: int) -> int:
        if i not in lsh:
            lsh[i] = simhash(part(i), cfg.minichunk, cfg.delta != "shingling")[0]
        return lsh[i]

    def try_delta(i: int, candidates: list[int]) -> tuple[list[Step], int] | None:
        ranked = sorted({j for j in candidates if usable(i, j)}, key=lambda j: ((similar_hash(i) ^ similar_hash(j)).bit_count(), -j))
        ranked = [j for j in ranked if (similar_hash(i) ^ similar_hash(j)).bit_count() <= cfg.max_distance]
        best: tuple[list[Step], int] | None = None
        for j in ranked if cfg.try_all else ranked[:1]:
            steps = delta(part(i), part(j), cfg.minichunk, cfg.delta != "shingling")
            if saving(steps) > cfg.min_saving and (best is None or saving(steps) > saving(best[0])):
                best = steps, j
        return best

    def write(i: int, steps: list[Step], j: int, earliest: int) -> None:
        for kind, at, size in steps:
            plan.add(kind, starts[j] + at if kind == COPY else starts[i] + at, size, earliest)

    for i in range(n):
        digest = hashlib.blake2b(part(i), digest_size=16).digest()
        hashes.append(digest)
        size = cuts[i] - starts[i]
        earliest = 0 if cfg.dictionary is None else starts[bisect_left(range(i), True, key=lambda j: usable(i, j))] if i else 0
        match = None
        if anchor is not None and anchor + 1 < i and hashes[anchor + 1] == digest and usable(i, anchor + 1):
            match = anchor + 1  # what followed the previous match follows again
        elif (instances := known.get(digest)) and usable(i, instances[-1]):
            match = instances[-1]
        fresh = digest not in known or match is None
        used_before[i + 1] = used_before[i] + (size if fresh else 0)
        if match is not None:
            known[digest].append(i)
            plan.add(COPY, starts[match], size, earliest)
            stats["dup_bytes"] += size
            duplicates.append((starts[i], cuts[i]))
            back = anchor is None and cfg.adjacency_back and cfg.delta is not None
            anchor = match
            if back:
                _walk_back(plan, i, match, unreduced, try_delta, write, starts, cuts, earliest, stats)
            continue
        known.setdefault(digest, []).append(i)
        stats["unique_chunks"] += 1
        found = None
        if cfg.delta is not None:
            candidates: list[int] = []
            if cfg.generalized and (j := bases.get(_base(similar_hash(i)))) is not None:
                candidates.append(j)
            if cfg.window:
                candidates += range(max(0, i - cfg.window), i)
            if cfg.features and (f := features(part(i))):
                held = [index.setdefault(key, {}) for key in enumerate(super_features(f))]
                shared = Counter(j for x in held for j in x)
                for j, times in shared.items():
                    if usable(i, j):
                        candidates.append(j)
                    if times == len(held) or not usable(i, j):  # what is out of reach stays so
                        for x in held:
                            x.pop(j, None)
                for x in held:
                    x[i] = None
            if cfg.adjacency and anchor is not None:
                candidates += [j + 1 for j in known.get(hashes[anchor], [])] if cfg.exhaustive_adjacency else [anchor + 1]
            if candidates:
                found = try_delta(i, candidates)
            if cfg.generalized:
                bases[_base(similar_hash(i))] = i
        if found:
            write(i, *found, earliest)
            stats["delta_chunks"] += 1
            stats["delta_bytes"] += saving(found[0])
            anchor = found[1]
        else:
            plan.add(INSERT, starts[i], size, earliest)
            unreduced.add(i)
            anchor = None
    stats["deduped_bytes"] = plan.copied(duplicates)  # of the whole plan: what follows a short copy may drop it
    stats |= {"instructions": len(plan.steps), "extended_forward": plan.extended_forward, "extended_back": plan.extended_back, "omitted": plan.omitted, "saved_bytes": saving(plan.steps), "total_bytes": len(data)}
    return plan.steps, stats


def _walk_back(plan, i, match, unreduced, try_delta, write, starts, cuts, earliest, stats) -> None:
    """Before the first match of a run: code the plain chunks before it against those before the match, while that saves."""
    found: list[tuple[int, list[Step], int]] = []
    k, j = i - 1, match - 1
    while k in unreduced and j >= 0 and j < k and (got := try_delta(k, [j])):
        found.append((k, *got))
        k, j = k - 1, j - 1
    if not found:
        return
    plan.take_back(cuts[i] - starts[k + 1])
    for k, steps, j in reversed(found):
        write(k, steps, j, earliest)
        unreduced.discard(k)
        stats["delta_chunks"] += 1
        stats["delta_bytes"] += saving(steps)
    plan.add(COPY, starts[match], cuts[i] - starts[i], earliest)


def _base(x: int) -> int:
    """See functions.bits.hamming_base."""
    syndrome = 0
    for k in range(64):
        if x >> k & 1:
            syndrome ^= k
    return (x ^ (1 << syndrome)) & ~1
