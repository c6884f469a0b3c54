"""Connected components of a graph that may be larger than any machine.

Each task first reduces its own edges to a spanning forest. Then rounds of contraction: every vertex moves to the neighbour
(or itself) of least seeded hash, edges are renamed, loops and repeats go. Hashes change each round, so that neither
long paths nor stars slow it down. Once at most ``LOCAL_EDGES`` edges are left (a fixed bound, 16 bytes each) one task
finishes them. The rounds' maps are composed backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch

LOCAL_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:
        pu, pv = parent[u], parent[v]
        low = np.minimum(pu, pv)
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        open_ = parent[u] != parent[v]
        if not open_.any():
            return ids, ids[parent]
        u, v = u[open_], v[open_]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def reduced() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        ids, root = roots(a, b)
        link = ids != root
        out = pa.RecordBatch.from_arrays([pa.array(root[link]), pa.array(ids[link])], names=["a", "b"])
        for i in range(0, max(1, len(out)), 50_000):
            yield out.slice(i, 50_000)

    for x in batches:
        held.append((x["a"].to_numpy(zero_copy_only=False), x["b"].to_numpy(zero_copy_only=False)))
        size += len(x)
        if size >= LOCAL_EDGES:
            yield from reduced()
            held, size = [], 0
    if held:
        yield from reduced()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: a, b (long). One row (id, component) for each vertex with an edge to another; component: its smallest id."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = scratch.table(e.mapInArrow(_forest, "a long, b long"), f"{name}-edges-0")
    maps: list[DataFrame] = []
    while e.count() > LOCAL_EDGES:
        k = len(maps)
        order = lambda c: F.xxhash64(F.lit(k), c)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("h"), F.col("b").alias("to"))).alias("m"))
        moved = least.select("a", F.when(F.col("m.h") < order(F.col("a")), F.col("m.to")).otherwise(F.col("a")).alias("to"))
        maps.append(scratch.table(moved, f"{name}-map-{k}"))
        m = maps[-1]
        e2 = e.join(m.withColumnRenamed("to", "a2"), "a").select("a2", "b")
        e2 = e2.join(m.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b").filter("a2 <> b2")
        e2 = e2.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        e = scratch.table(e2.mapInArrow(_forest, "a long, b long"), f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x["a"].to_numpy(zero_copy_only=False), x["b"].to_numpy(zero_copy_only=False)) for x in batches]
        if got:
            ids, root = roots(np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "component"])

    labels = scratch.table(e.repartition(1).mapInArrow(finish, "id long, component long"), f"{name}-last")
    if not maps:
        return labels
    for m in reversed(maps):
        known = labels.select(F.col("id").alias("to"), "component")
        labels = m.join(known, "to", "left").select(F.col("a").alias("id"), F.coalesce("component", "to").alias("component"))
    labels = scratch.table(labels, f"{name}-labels")
    smallest = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(smallest, "component").select("id", F.col("least").alias("component"))
