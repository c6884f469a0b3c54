"""Embedding near-dedup: exact metric range join by pivots.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other, so the join is a range join in Euclidean space,
done for each label by itself.

1. Equal vectors of a label become one class with its number of copies.
2. Pivots of a label are drawn from a bounded sample and kept well apart, about one for each ``cell`` classes, at most ``PIVOTS``.
   Every class belongs to its nearest pivot's cell. A class x of cell i may link with one of cell j only if
   d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j): the triangle inequality sharpened to the bisecting plane. Then x is
   replicated to j, so every link of a class lies in its own cell. A cell that is still large is divided in the same way by pivots of its own, and so
   on, so pivots grow with the data and each vector meets at most ``PIVOTS`` of them a level. Where a sample shows that replicas would undo the gain,
   a cell stays whole.
3. Cells join independently. A cell with more than ``block`` rows is cut into blocks, and pairs of blocks are tasks, so
   no task holds more than two blocks. A task counts links and keeps a spanning forest, never the pairs.
4. Components of the forests' edges; copies take their class's counts and component.

Cosines are computed in double precision from the original components; those within 1e-9 of the threshold again
from the plain sums. The result is exact: pivots and blocks change costs only.

Defined results. Null label, null or empty vector, null, NaN or infinite component, zero vector: no links, a component of its own.
Vectors of different lengths do not link. A null vec_id is no vertex: its row has links 0 and component null.
Repeated vec_ids are one vertex. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch
from chunkloom.llm.components import components

COSINE = 0.98
CELL = 2_048  # classes for each pivot
PIVOTS = 256  # of a label or cell at most
GROUPS = 1_024  # labels or cells that one level divides, the largest first; the next level takes the others
LEVELS = 12  # what is large after so many is joined block by block
SAMPLED = 8 << 20  # numbers in all vectors of a level's sample: the bound of what the driver sees; pivots are a part of it
GAIN = 0.7  # a cell is divided if pairs to be compared fall below this share
BLOCK = 2_048
EDGE = 1e-9


def valid(vector, label=None):
    """Whether a vector takes part."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if label is None else ok & label.isNotNull(), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))))


def links_of(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y link; x, y as given, ux, uy normalised."""
    s = ux @ uy.T
    out = s >= cosine
    for i, j in np.argwhere(np.abs(s - cosine) < EDGE):
        out[i, j] = exact_cosine(x[i], y[j]) >= cosine
    return out


def pick_pivots(x: np.ndarray, wanted: int, apart: float) -> np.ndarray:
    """Up to wanted rows of x in their order that are apart from each other."""
    chosen: list[int] = []
    near = np.full(len(x), np.inf)
    for i in range(len(x)):
        if near[i] > apart:
            chosen.append(i)
            near = np.minimum(near, np.sqrt(np.maximum(0, 2 - 2 * x @ x[i])))
            if len(chosen) == wanted:
                break
    return x[chosen]


def metric_join(vectors: DataFrame, *, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "metric-join")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    usable = rows.filter(valid(F.col("v"), F.col("label")) & F.col("vec_id").isNotNull()).withColumns({"dims": F.size("v"), "k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "v", "label")})
    # A hot vector's copies meet as partial minima and counts.
    classes = scratch.table(usable.groupBy("k1", "k2", "label", "dims", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "classes")

    radius = float(np.sqrt(2 - 2 * cosine)) + EDGE
    todo, cells = classes.select("label", "dims", F.lit("").alias("cell"), F.lit(True).alias("own"), "rep", "copies", "v"), None
    schema = todo.schema

    def among(part: DataFrame, names: Iterable[tuple[str, int, str]], how: str) -> DataFrame:
        keys = part.sparkSession.createDataFrame(list(names), "label string, dims int, cell string")  # at most GROUPS rows
        return part.join(F.broadcast(keys), ["label", "dims", "cell"], how)

    for level in range(LEVELS):
        pivots, whole, more = _pivots(todo, cosine, cell, radius)
        rest = among(todo, pivots, "left_anti")
        final = among(rest, whole, "left_semi") if more else rest  # what this level had no room for waits for the next one
        cells = final if cells is None else cells.unionByName(final)
        if not pivots and not more:
            break
        divided = among(todo, pivots, "left_semi").mapInArrow(_divider(pivots, radius), schema)
        todo = scratch.table(divided.unionByName(among(rest, whole, "left_anti")) if more else divided, f"level-{level}")
    else:
        cells = cells.unionByName(todo)
    cells = scratch.table(cells, "cells")
    sizes = cells.groupBy("label", "dims", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = cells.join(sizes, ["label", "dims", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dims", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "own", "rep", "copies", "v")

    def join(key: tuple, t: pa.Table) -> pa.Table:
        d, i, j = key[1].as_py(), key[3].as_py(), key[4].as_py()
        x = matrix(t["v"], d)
        u = unit(x)
        mine, rep, own, copies = (t[c].to_numpy() for c in ("mine", "rep", "own", "copies"))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        n_links = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))
        for s in range(0, len(left), 256):
            rows_ = left[s : s + 256]
            hit = links_of(x[rows_], x[right], u[rows_], u[right], cosine)
            if i == j:
                hit[rep[rows_][:, None] == rep[right][None, :]] = False
            n_links[rows_] += hit @ copies[right]
            if i != j:
                n_links[right] += hit.T @ copies[rows_]
            for k in np.flatnonzero(hit.any(axis=1)):
                joined = np.unique(np.append(root[right[hit[k]]], root[rows_[k]]))
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        # What is replicated here is counted in its own cell; its edges count all the same.
        keep = (own & (n_links > 0)) | (root != np.arange(len(rep)))
        return pa.table({"rep": rep[keep], "links": np.where(own, n_links, 0)[keep], "root": rep[root][keep]})

    found = scratch.table(pairs.groupBy("label", "dims", "cell", "i", "j").applyInArrow(join, "rep long, links long, root long"), "found")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_copies = usable.select("vec_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep", "copies"), ["k1", "k2"]).join(counted, "rep", "left")
    per_id = of_copies.groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.min("rep").alias("rep"), F.max("rep").alias("last"))
    same = per_id.filter("rep <> last").select(F.col("rep").alias("a"), F.col("last").alias("b"))
    graph = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same), scratch)
    known = per_id.join(graph.withColumnRenamed("id", "rep"), "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def reached(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of pivots p for unit vectors x, and the cells in which each has to be for links within radius."""
    near = 2 - 2 * (x @ p.T)  # squared distances
    first = near.argmin(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
    reach = near - near[np.arange(len(x)), first][:, None] <= 2 * radius * gap[first] + EDGE
    reach[np.arange(len(x)), first] = True
    return first, reach


def _divider(pivots: dict[tuple[str, int, str], np.ndarray], radius: float):
    """Rows of the cells with pivots to their new cells; a replica belongs nowhere, and neither do its own replicas."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b["label"].to_pylist(), b["dims"].to_pylist(), b["cell"].to_pylist()))
            for key in sorted(set(keys)):
                part = b.take(pa.array([i for i, k in enumerate(keys) if k == key]))
                first, reach = reached(unit(matrix(part["v"], key[1])), pivots[key], radius)
                where, cells = np.nonzero(reach)
                out = part.take(pa.array(where))
                own = out["own"].to_numpy(zero_copy_only=False) & (cells == first[where])
                names = pa.array([f"{key[2]}.{c}" for c in cells.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([out["label"], out["dims"], names, pa.array(own), out["rep"], out["copies"], out["v"]], names=["label", "dims", "cell", "own", "rep", "copies", "v"])

    return divide


def _pivots(cells: DataFrame, cosine: float, cell: int, radius: float) -> tuple[dict[tuple[str, int, str], np.ndarray], list[tuple[str, int, str]], bool]:
    """Of the cells with more than two cells' worth of rows: pivots of those to divide, those to leave whole, and whether there are more than GROUPS."""
    key = ["label", "dims", "cell"]
    counts = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * cell)
    large = counts.orderBy(F.desc("n"), *key).limit(GROUPS + 1).collect()
    left, large = len(large) > GROUPS, large[:GROUPS]
    if not large:
        return {}, [], False
    room = SAMPLED // (len(large) * max(r["dims"] for r in large))  # vectors of each sample
    shares = [(r["label"], r["dims"], r["cell"], min(1.0, max(2, min(room, 16 * min(PIVOTS, r["n"] // cell))) / r["n"])) for r in large]
    shares_ = cells.sparkSession.createDataFrame(shares, "label string, dims int, cell string, share double")
    spread = F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1_000_000)) / F.lit(1e6)
    drawn = cells.join(F.broadcast(shares_), key).filter(spread < F.col("share")).select(*key, "rep", "v").toArrow().sort_by("rep")
    names = list(zip(*(drawn[c].to_pylist() for c in key)))
    out, whole = {}, []
    for r in large:
        name = (r["label"], r["dims"], r["cell"])
        x = drawn.filter(pa.array([k == name for k in names], pa.bool_()))
        whole.append(name)
        if len(x) < 2:
            continue
        x = unit(matrix(x["v"], r["dims"]))
        p = pick_pivots(x[np.random.Generator(np.random.PCG64(len(x))).permutation(len(x))], min(PIVOTS, r["n"] // cell), 4 * float(np.sqrt(2 - 2 * cosine)))
        if len(p) > 1:
            share = reached(x, p, radius)[1].mean(axis=0)  # of the cell's rows in each new one
            if (share * share).sum() < GAIN:
                out[name] = p
                whole.pop()
    return out, whole, left
