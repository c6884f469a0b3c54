"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index. Vectors are dealt to cells by the nearest of a few centres (about one for each ``CELL`` vectors, at most ``CELLS``, fitted on a bounded sample; they
change costs and the bounds' width only). A vector is taken relative to its cell's centre, scaled to unit length, turned by a
seeded random orthogonal matrix and reduced to the signs of its components, packed into words of 64 bits; beside the bits stand the
distance to the centre and the code's inner product with the vector, the correction scalar. Every row is indexed.

Search. A query's components are rounded to 4 bits and laid out as four bit planes, so that its inner product with a code is four
ands and population counts of the packed words. From it the inner product with the vector is estimated without bias as
<query, code> / <vector, code>; its error is below eps standard errors, of which (1 - f^2) / f^2 / (dims - 1) comes from the code with
correction scalar f and the rest from the rounding. So each candidate has a lower and an upper bound of its distance.

1. A query searches its own cell. The exact distances of a block's ``FIRST`` best estimates bound that of its k-th neighbour; all
   candidates whose lower bound does not exceed it are reranked on the original vectors.
2. With the k-th distance so far it searches every other cell that the triangle inequality does not rule out, in the same way; only
   candidates whose lower bound is below that distance are looked at.

Scale. Tasks hold a block of a cell's codes (a fixed number), their originals and a group of queries. Blocks are dealt once for every ``QUERIES`` queries
that probe their cell, so originals move once or twice unless there are more queries than that. One bit for each component says little where
neighbours are hardly nearer than other vectors: on such data a tenth of a block may be reranked, which is why originals lie beside their codes. Equal
vectors are one candidate and one query: its smallest ids stand for it, which is exact for k neighbours, so copies cost nothing.

Defined results. Null, empty and zero vectors and those with null or non-finite components take no part. Only vectors of
one length are comparable: each length is searched by itself, with centres, rotation and blocks of its own. Fewer candidates than k: all of them.
Ties go to the smaller id. A null id takes no part; repeated ids are separate candidates at the same place, and one query.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch
from chunkloom.llm.metric_join import matrix, valid

K = 10
EPS = 2.0  # standard errors of the bounds
BLOCK = 32_768  # codes of a task
QUERIES = 16_384  # queries of a task
FIRST = 32  # best estimates that give the first exact distances
CELL, CELLS = 32_768, 1_024  # vectors for each cell; cells at most
SAMPLE = 10_000  # vectors that centres are fitted on
PLANES = 4  # bits of a query's component
SEED = 77


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, distances to the centre (one, or one for each row), correction scalars."""
    y = x - centre
    norm = np.sqrt((y * y).sum(axis=1))
    y = (y / np.where(norm > 0, norm, 1)[:, None]) @ turn
    return np.packbits(y > 0, axis=1), norm, np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed in the order of the components."""
    d = q - x
    return np.sqrt(np.cumsum(d * d, axis=-1)[..., -1])


def centres_of(x: np.ndarray, wanted: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's method from a seeded start; at least one."""
    if len(x) <= wanted or wanted < 2:
        return x.mean(axis=0, keepdims=True)
    centres = x[np.random.Generator(np.random.PCG64(SEED)).choice(len(x), wanted, replace=False)]
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        n = np.bincount(own, minlength=wanted)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as words of 64, filled up with zeros."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def products(query: np.ndarray, codes: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of a turned query with codes, their components being +-1 / sqrt(dims), and the rounding's variance. ones: each code's bits."""
    dims, low = len(query), float(query.min())
    step = (float(query.max()) - low) / ((1 << PLANES) - 1) or 1.0
    level = np.rint((query - low) / step).astype(np.uint8)
    dot = np.zeros(len(codes), np.int64)
    for k in range(PLANES):
        plane = words(np.packbits((level >> k) & 1)[None, :])
        dot += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << k
    return (2 * (low * ones + step * dot) - float((low + step * level).sum())) / np.sqrt(dims), step * step / 12


def bounds(q: np.ndarray, codes: np.ndarray, ones: np.ndarray, norm: np.ndarray, f: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds and estimates of a query's squared distances to the vectors of packed codes."""
    y = q - centre
    away = float(np.sqrt((y * y).sum()))
    f = np.where(f > 0, f, 1)
    inner, rounding = products((y / (away or 1)) @ turn, codes, ones)
    slack = eps * np.sqrt((np.maximum(0, 1 - f * f) / max(1, len(q) - 1) + rounding) / (f * f))
    middle, cross = away * away + norm * norm, 2 * away * norm
    return middle - cross * np.minimum(inner / f + slack, 1), middle - cross * (inner / f)


def search_block(q: np.ndarray, limits: np.ndarray, x: np.ndarray, packed: np.ndarray, norm: np.ndarray, f: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, eps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and distances of the vectors of a block that may be among its k nearest within its limit."""
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    out = []
    for y, limit in zip(q, limits):
        low, middle = bounds(y, packed, ones, norm, f, centre, turn, eps)
        n = min(len(x), max(FIRST, k))
        first = np.argpartition(middle, n - 1)[:n]
        first = first[low[first] <= limit * limit + 1e-12]
        known = distances(y, x[first])
        bound = min(limit, np.partition(known, k - 1)[k - 1]) if len(first) >= k else limit
        at = np.union1d(np.flatnonzero(low <= bound * bound + 1e-12), first)
        d = distances(y, x[at])
        last = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf  # ties of the last one are settled by ids
        at, d = at[d <= last], d[d <= last]
        out.append((at, d))
    return out


def nearest(vectors: DataFrame, is_query: Column, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", eps: float = EPS, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest other rows."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), "_query")
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("v"))).withColumn("dims", F.size("v"))
    # As many rows as there are lengths of vectors; each length that is asked is searched by itself.
    found = rows.groupBy("dims").agg(F.max("_query").alias("asked")).filter("asked").orderBy("dims").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else None
    for r in found:
        part = _nearest(rows.filter(F.col("dims") == r["dims"]), r["dims"], Scratch(spark, "rabitq"), k, eps, block, group)
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(rows: DataFrame, dims: int, scratch: Scratch, k: int, eps: float, block: int, group: int) -> DataFrame:
    """nearest for rows (vec_id, v, _query) whose vectors have one length, with at least one query."""
    spark = rows.sparkSession
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})

    # The k + 1 smallest ids of equal vectors; one of them may be the query itself.
    small = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(small)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    asked = rows.filter("_query").select("k1", "k2").distinct().withColumn("asked", F.lit(True))
    table = scratch.table(classes.join(asked, ["k1", "k2"], "left"), "classes")
    n, n_asked = table.agg(F.count(F.lit(1)), F.count("asked")).first()

    spread = F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(1_000_000)) / F.lit(1e6)
    drawn = table.filter(spread < min(1.0, SAMPLE / n)).select("v").toPandas()["v"].tolist()  # bounded
    centres = centres_of(np.array(drawn, dtype=np.float64), min(CELLS, n // CELL)) if drawn else np.zeros((1, dims))
    turn = rotation(dims)

    def index(batches):
        for b in batches:
            x = matrix(b["v"], dims)
            cell = nearest_centre(x, centres)
            bits, norm, f = encode(x, centres[cell], turn)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(b), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b["k1"], b["k2"], b["ids"], b["v"], b["asked"], pa.array(cell, pa.int64()), code, pa.array(norm), pa.array(f)], names=["k1", "k2", "ids", "v", "asked", "cell", "code", "norm", "f"])

    v_type = table.schema["v"].dataType.simpleString()
    codes = scratch.table(table.select("k1", "k2", "ids", "v", "asked").mapInArrow(index, f"k1 long, k2 long, ids array<long>, v {v_type}, asked boolean, cell long, code binary, norm double, f double"), "codes")
    # One row for each cell, at most CELLS.
    cells = {r["cell"]: r for r in codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count("asked").alias("asked"), F.max("norm").alias("radius")).collect()}
    # Small tables use the cluster, too: their blocks are smaller.
    block = min(block, max(2_048, n // 32))
    blocks = {c: -(-r["n"] // block) for c, r in cells.items()}

    def searched(probes: DataFrame, groups: dict[int, int], name: str) -> DataFrame:
        """probes: k1, k2, v, bound (may be null) and cell. For each the vectors of the cell's blocks that may be among its k + 1 nearest, itself included."""
        dealt = spark.createDataFrame([(c, blocks[c], groups[c]) for c in blocks if groups.get(c)], "cell long, blocks long, groups long")
        many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        hashed = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.col(c))
        none = F.lit(None)
        mine = codes.join(F.broadcast(dealt), "cell").withColumn("block", hashed(8, "blocks")).withColumn("group", many("groups"))
        mine = mine.select("cell", "block", "group", "k1", "k2", "v", "ids", "code", "norm", "f", none.cast("double").alias("bound"))
        asks = probes.join(F.broadcast(dealt), "cell").withColumn("group", hashed(9, "groups")).withColumn("block", many("blocks"))
        asks = asks.select("cell", "block", "group", "k1", "k2", "v", none.cast("array<long>").alias("ids"), none.cast("binary").alias("code"), none.cast("double").alias("norm"), none.cast("double").alias("f"), "bound")

        def search(key: tuple, t: pa.Table) -> pa.Table:
            is_code = t["code"].is_valid()
            have, queries = t.filter(is_code), t.filter(pc.invert(is_code))
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "vec_id", "score")}
            if len(have) and len(queries):
                packed = words(np.frombuffer(b"".join(have["code"].to_pylist()), np.uint8).reshape(len(have), -1))
                ids = have["ids"].to_pylist()
                limits = np.array([np.inf if x is None else x for x in queries["bound"].to_pylist()])
                found = search_block(matrix(queries["v"], dims), limits, matrix(have["v"], dims), packed, have["norm"].to_numpy(), have["f"].to_numpy(), centres[key[0].as_py()], turn, k + 1, eps)
                for a, b, (at, d) in zip(queries["k1"].to_pylist(), queries["k2"].to_pylist(), found):
                    hits = sorted((x, i) for p, x in zip(at.tolist(), d.tolist()) for i in ids[p])[: k + 1]
                    out["k1"] += [a] * len(hits)
                    out["k2"] += [b] * len(hits)
                    out["score"] += [x for x, _ in hits]
                    out["vec_id"] += [i for _, i in hits]
            return pa.table([pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=list(out))

        found = mine.unionByName(asks).groupBy("cell", "block", "group").applyInArrow(search, "k1 long, k2 long, vec_id long, score double")
        return scratch.table(found, name)

    best = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("score", "vec_id"))
    own = codes.filter("asked").select("k1", "k2", "v", "cell")
    hits = searched(own.withColumn("bound", F.lit(None).cast("double")), {c: -(-r["asked"] // group) for c, r in cells.items()}, "own")
    if len(cells) > 1:
        order = sorted(cells)
        wide = np.array([cells[c]["radius"] for c in order])
        limits = hits.withColumn("place", best).filter(F.col("place") == k + 1).select("k1", "k2", F.col("score").alias("bound"))

        def reach(batches):
            for b in batches:
                x, home = matrix(b["v"], dims), b["cell"].to_numpy()
                bound = np.array([np.inf if y is None else y for y in b["bound"].to_pylist()])
                for s in range(0, len(x), 256):
                    part = x[s : s + 256]
                    away = np.sqrt(np.maximum(0, (part * part).sum(axis=1)[:, None] - 2 * part @ centres[order].T + (centres[order] ** 2).sum(axis=1)))
                    row, col = np.nonzero((away - wide <= bound[s : s + 256, None] + 1e-6) & (np.array(order) != home[s : s + 256, None]))
                    out = b.take(pa.array(row + s))
                    yield pa.RecordBatch.from_arrays([out["k1"], out["k2"], out["v"], out["bound"], pa.array(np.array(order)[col], pa.int64())], names=["k1", "k2", "v", "bound", "cell"])

        probes = own.join(limits, ["k1", "k2"], "left").select("k1", "k2", "v", "bound", "cell").mapInArrow(reach, f"k1 long, k2 long, v {v_type}, bound double, cell long")
        probes = scratch.table(probes, "probes")
        asked_of = {r["cell"]: -(-r["n"] // group) for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows
        hits = hits.unionByName(searched(probes, asked_of, "others"))
    top = scratch.table(hits.withColumn("n", best).filter(F.col("n") <= k + 1).drop("n"), "top")
    per_query = rows.filter("_query").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct().join(top, ["k1", "k2"]).filter("query_id <> vec_id")
    ranked = per_query.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
