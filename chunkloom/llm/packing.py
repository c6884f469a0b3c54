"""Best-fit packing with variable capacities.

Texts are packed into sequences of a few permitted lengths. A text longer than the largest capacity is cut into pieces of
that length and a rest; every piece is one item. Items are dealt into groups of about ``group`` items by a seeded hash and
each group is packed by itself from the longest item down: an item goes into the open bin that it leaves least room in;
if none has room, a bin is opened of the size whose cost (its length and a fixed cost for each sequence) is least for each token that can
still come into it. In the end each bin is downsized to the smallest permitted length that holds its contents. Only ids and
lengths move; a group wastes one open bin at most of each size, and no task sees more than its group.

Defined results. Every row of the input gives at least one row. Null, empty and blank texts have no tokens and no bin
(bin_id, capacity and offset null). Equal lengths are packed in order of id, then of their place in the scan. Repeated ids are separate items.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm._common import Scratch

CAPACITIES = (512, 1024, 2048, 4096)
PER_SEQUENCE = 16.0  # cost of a sequence besides its length, in tokens
GROUP = 8_192
SEED = 31


def words_of(text: Column) -> Column:
    """Default length: number of runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def best_fit(sizes: Sequence[int], capacities: Sequence[int], per_sequence: float = PER_SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sizes: positive, in descending order, none above the largest capacity. Bin and offset of each item; capacity of each bin."""
    caps = sorted(capacities)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # bins by what is left in them
    some = 0  # bit i: there is a bin with i left
    left = int(sum(sizes))
    for i, size in enumerate(sizes):
        fits = some >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            at = room[rest].pop()
            if not room[rest]:
                some &= ~(1 << rest)
        else:
            rest = min((c for c in caps if c >= size), key=lambda c: ((c + per_sequence) / min(c, left), c))
            at = len(used)
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        left -= size
        rest -= size
        if rest:
            room[rest].append(at)
            some |= 1 << rest
    return bins, offsets, np.array(caps)[np.searchsorted(caps, used)] if used else np.empty(0, np.int64)


def pack(docs: DataFrame, *, capacities: Sequence[int] = CAPACITIES, per_sequence: float = PER_SEQUENCE, group: int = GROUP, id_col: str = "doc_id", length: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, offset, capacity: one row per piece."""
    spark, scratch, largest = docs.sparkSession, Scratch(docs.sparkSession, "packing"), max(capacities)
    n = (words_of(F.col("text")) if length is None else length).cast("long")
    lengths = scratch.table(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n")).withColumn("place", F.monotonically_increasing_id()), "lengths")
    total = lengths.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("n") / largest), F.lit(1))), F.lit(0)).alias("items")).first()["items"]
    groups = max(1, -(-total // group))
    last = F.greatest(F.ceil(F.col("n") / largest).cast("long") - 1, F.lit(0))
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start", F.col("piece") * largest).withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(largest)))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "place", "piece"), F.lit(groups)))
    id_type = lengths.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("piece", "start", "n_tokens", "bin_id", "offset", "capacity")])
    caps = tuple(capacities)

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        number = key[0].as_py()
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("place", "ascending"), ("piece", "ascending")])
        size = t["n_tokens"].to_numpy()
        some = int(np.count_nonzero(size))
        bins, offsets, chosen = best_fit(size[:some].tolist(), caps, per_sequence)
        none = np.arange(len(size)) >= some
        fill = lambda x: pa.array(np.concatenate((x, np.zeros(len(size) - some, np.int64))), pa.int64(), mask=none)
        out = t.select(["doc_id", "piece", "start", "n_tokens"])
        return out.append_column("bin_id", fill(bins + (number << 32))).append_column("offset", fill(offsets)).append_column("capacity", fill(chosen[bins] if some else bins))

    return dealt.select("group", "doc_id", "place", "piece", "start", "n_tokens").groupBy("group").applyInArrow(packed, schema)
