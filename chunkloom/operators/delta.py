"""Delta encoding of a chunk against a similar one: copies from it and inserts.

The ends that both share are matched first, then parts of equal content (fixed blocks or content-defined ones), each
extended both ways as far as bytes agree; of several places the one that extends furthest is taken, the later of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chunkloom.functions.bits import common_prefix, common_suffix
from chunkloom.operators.resemblance import minichunk_cuts

COPY, INSERT = "COPY", "INSERT"
Step = tuple[str, int, int]  # type, offset in the similar chunk (COPY) or in the chunk (INSERT), size


def delta(chunk: bytes, similar: bytes, size: int = 16, content_defined: bool = True) -> list[Step]:
    """Steps that make chunk from similar, in order; their sizes add up to the chunk's."""
    head = common_prefix(chunk, similar)
    tail = common_suffix(chunk, similar)
    places: dict[bytes, list[int]] = {}
    cuts = minichunk_cuts(similar, size, content_defined)
    for a, b in zip([0, *cuts], cuts):
        places.setdefault(similar[a:b], []).append(a)
    steps: list[Step] = [(COPY, 0, head)] if head else []
    done = head  # bytes of chunk that steps cover
    cuts = minichunk_cuts(chunk, size, content_defined)
    for a, b in zip([0, *cuts], cuts):
        if b <= done or not (found := places.get(chunk[a:b])):
            continue
        best = (-1, 0, 0, 0)
        for p in found:
            back = common_suffix(chunk[:a], similar[:p])
            ahead = common_prefix(chunk[b:], similar[p + b - a :])
            if back + ahead >= best[0]:
                best = (back + ahead, back, ahead, p)
        _, back, ahead, p = best
        start = a - back
        if start > done:
            steps.append((INSERT, done, start - done))
        else:  # what earlier steps cover again is theirs no longer
            over = done - start
            while over:
                kind, at, n = steps.pop()
                if n > over:
                    steps.append((kind, at, n - over))
                over -= min(over, n)
        steps.append((COPY, p - back, back + b - a + ahead))
        done = b + ahead
    end = max(done, len(chunk) - tail)
    if done < end:
        steps.append((INSERT, done, end - done))
    if end < len(chunk):
        steps.append((COPY, len(similar) - (len(chunk) - end), len(chunk) - end))
    return steps


def apply_delta(steps: list[Step], chunk: bytes, similar: bytes) -> bytes:
    """The chunk again; inserts take their bytes from chunk."""
    return b"".join(similar[at : at + n] if kind == COPY else chunk[at : at + n] for kind, at, n in steps)


def saving(steps: list[Step]) -> int:
    """Bytes that copies make up."""
    return sum(n for kind, _, n in steps if kind == COPY)


def delta_pairs(pairs: DataFrame, *, size: int = 16, content_defined: bool = True) -> DataFrame:
    """pairs (with binary columns chunk and similar) and saved, n_steps, restored (whether the steps give the chunk)."""
    rest = [f for f in pairs.schema.fields if f.name not in ("chunk", "similar")]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("saved", T.LongType()), T.StructField("n_steps", T.LongType()), T.StructField("restored", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            saved, count, right = [], [], []
            for c, s in zip(b["chunk"].to_pylist(), b["similar"].to_pylist()):
                steps = delta(c or b"", s or b"", size, content_defined)
                saved.append(saving(steps))
                count.append(len(steps))
                right.append(apply_delta(steps, c or b"", s or b"") == (c or b""))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(saved, pa.int64()), pa.array(count, pa.int64()), pa.array(right, pa.bool_())], names=[*names, "saved", "n_steps", "restored"])

    return pairs.mapInArrow(run, schema)
