"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

1. Every whole text becomes its set of word shingles (hashes of 64 bits), a digest of the set and a signature of
   trees x depth minima. Documents with equal sets are one class from here on; one signature for each class.
2. Forest: each tree puts the classes in the order of its ``depth`` minima. Regions of a common prefix of ``least_depth``
   minima with more than ``region`` classes are split by the next minimum, and so on (adaptive depth). Neighbours in the
   order whose longest common prefix reaches their region's depth are candidates: at most ``window`` on either side for each class and tree.
   Next neighbours are candidates from ``least_depth`` minima on, so all classes of a common prefix are connected. Orders are
   range-partitioned, so a region may span tasks and no task holds more than its range; tasks' first and last classes are linked likewise.
3. Candidates' components are groups, cut into blocks of about ``block`` classes. All classes of a group are compared with
   one another on full sets, a task taking one block or two; only a spanning forest of the links leaves it. Groups of more
   than ``grid`` classes are compared within their blocks, then their other candidates whose ends are not connected yet are
   confirmed pair by pair, first the best one between any two components, then all. What these leave is found exactly: two
   linked sets share one of the rarest 25 % of either's shingles (in any one order), so an equi-join on these, with bounds by sizes and
   positions, has every linked pair of classes that are not connected yet, and all of its pairs are confirmed. In a dense group, where that join has about as many
   pairs as there are, all of its blocks of ``LARGE_BLOCK`` classes are compared with one another instead, by products of matrices.
4. Components of confirmed links; each class takes its component's smallest doc_id.

Two documents link if 100 * intersection >= 75 * union, on exact sets. With 24 trees of least depth 3 a pair at the
threshold gets into one group by none of them with a chance of at most (1 - 0.75^3)^24 = 2e-6; nearer pairs less. It is enough that
both get into one group, by whatever candidates: within a group no link depends on ``window``, ``region`` or ``grid``.

Defined results. Null and blank texts have the empty set and are linked with nothing; fewer words than a shingle are one
shingle. Rows with a null doc_id are linked with nothing and have component null. Rows that share a doc_id are one
document and so are connected. Ties do not arise: components are named by their smallest doc_id. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch
from chunkloom.llm.components import components
from chunkloom.sources.streams import spread

WORDS = 5
PERCENT = 75
TREES, DEPTH, LEAST_DEPTH = 24, 6, 3
REGION = 64
WINDOW = 6  # neighbours on either side in an order
BLOCK = 256  # classes of a block
GRID = 4_096  # classes of a group that are all compared with one another
PAIR_COST = 40  # comparisons in a product of blocks that cost as much as one pair by itself
LARGE_BLOCK, BLOCK_BYTES = 2_048, 32 << 20  # classes of a block of a group beyond the grid, and bytes of text in it
SAMPLED = 4_096  # classes from which the frequent shingles of large groups are learned; they set an order only
FREQUENT = 200_000  # frequent shingles that are told apart
COLUMNS = 4_096  # shingles of one matrix product
SEED = 8_191
HASHED_AT_ONCE = 1 << 21  # minima computed in one numpy call

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and blanks 9-13 and 32
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in parts], dtype=np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)  # shorter sequences are no shingles of full length
    for k in range(n):
        out = out * _MIX + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(out))


def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the seeded hashes, their middle 16 bits: 3 of them tell 2^48 regions apart."""
    step = max(1, HASHED_AT_ONCE // len(a))
    out = None
    for i in range(0, len(hashes), step):
        part = ((hashes[i : i + step, None] * a + b) >> np.uint64(32)).min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return (out >> np.uint64(8)).astype(np.uint16)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Jaccard similarity of two sorted sets, at least percent / 100."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH, region: int = REGION, window: int = WINDOW, block: int = BLOCK, grid: int = GRID) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(trees * depth)
        for x in batches:
            for i in range(0, len(x), 2_000):
                part = x.slice(i, 2_000)
                n, digests, signatures = [], [], []
                for t in part["text"]:
                    s = shingles(t.as_py(), words)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signatures.append(signature(s, a, b).astype(">u2").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    known = scratch.table(spread(rows).mapInArrow(sets, "doc_id long, n_shingles long, digest binary, signature binary"), "sets")
    linkable = known.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # The signature is a function of the digest, so any of a class's will do.
    classes = scratch.table(linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")

    edges = _forest(classes, scratch, trees, depth, least_depth, region, window)
    groups = components(edges, scratch, "candidates-cc")
    texts = _texts(rows, groups, scratch, block)
    confirmed = _confirm(texts, edges, groups, scratch, words, percent, block, grid)

    # Rows of one doc_id with different texts are one document.
    of_class = linkable.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    same = of_class.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high OR low <> doc_id")
    repeated = same.filter("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    links = confirmed.unionByName(repeated)
    found = components(links, scratch, "links-cc")
    by_class = classes.select("digest", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # A hot class may hold a third of all rows: a plain join, whose large partitions Spark splits.
    out = known.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _forest(classes: DataFrame, scratch: Scratch, trees: int, depth: int, least: int, region: int, window: int) -> DataFrame:
    """Candidates: a, b and their weight, the summed lengths of common prefixes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * depth
        for x in batches:
            for i in range(0, len(x), 1_000):
                part = x.slice(i, 1_000)
                key = np.empty((len(part), trees, 1 + width), np.uint8)  # the tree, then its minima
                key[:, :, 0] = np.arange(trees)
                key[:, :, 1:] = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint8).reshape(-1, trees, width)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1 + width), len(part) * trees, [None, pa.py_buffer(key.tobytes())])
                yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(np.repeat(part["rep"].to_numpy(zero_copy_only=False), trees))], names=["key", "rep"])

    ordered = classes.select("rep", "signature").mapInArrow(keys, "key binary, rep long")
    n = max(64, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(n, "key", "rep").sortWithinPartitions("key", "rep")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(b"".join(x["key"].to_pylist()), np.uint8).reshape(len(x), -1), x["rep"].to_numpy(zero_copy_only=False)) for x in batches if len(x)]
        if not got:
            return
        key, rep = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        n = len(rep)
        edge = np.unique([0, n - 1])  # two rows of each task, by which its order goes on in the next
        none = pa.nulls(len(edge), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rep[edge]), none, none, pa.array([key[k].tobytes() for k in edge], pa.binary())], names=["a", "b", "lcp", "edge"])
        if n < 2:
            return
        # Longest common prefix with the next one, in minima; -1 across trees.
        same = key[:-1, 1:].reshape(n - 1, depth, 2) == key[1:, 1:].reshape(n - 1, depth, 2)
        lcp = np.cumprod(same.all(axis=2), axis=1).sum(axis=1)
        lcp[key[:-1, 0] != key[1:, 0]] = -1
        # The depth at which a pair's region has at most `region` classes.
        wanted = np.full(n - 1, depth)
        for d in range(depth - 1, least - 1, -1):
            run = np.concatenate(([0], np.cumsum(lcp < d)))
            size = np.bincount(run)[run]
            wanted[size[:-1] <= region] = d
        shared, need = lcp, wanted
        for step in range(1, min(window, n - 1) + 1):  # the next one, the one after it, and so on within a region
            if step > 1:
                shared, need = np.minimum(shared[:-1], lcp[step - 1 :]), np.maximum(need[:-1], wanted[step - 1 :])
            chosen = shared >= (need if step > 1 else least)
            a, b = rep[:-step][chosen], rep[step:][chosen]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared[chosen].astype(np.int64)), pa.nulls(len(a), pa.binary())], names=["a", "b", "lcp", "edge"])

    pairs = ordered.mapInArrow(neighbours, "a long, b long, lcp long, edge binary").filter("edge IS NOT NULL OR a <> b")
    found = scratch.table(pairs.groupBy("a", "b", "edge").agg(F.sum("lcp").alias("weight")), "candidates")
    edges = sorted((bytes(r["edge"]), r["a"]) for r in found.filter("edge IS NOT NULL").collect())  # two rows of each task
    across = [(min(a, b), max(a, b), least) for (k, a), (k_, b) in zip(edges, edges[1:]) if a != b and k[: 1 + 2 * least] == k_[: 1 + 2 * least]]
    found = found.filter("edge IS NULL").select("a", "b", "weight")
    return found.unionByName(classes.sparkSession.createDataFrame(across, "a long, b long, weight long")) if across else found


def _texts(rows: DataFrame, groups: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Texts of the classes that have candidates: rep, group, its size and number of blocks, block, text.

    Group and block are settled on ids, before any text moves. Blocks are dealt by a hash of the id, so no task grows with a
    group, whatever its classes have in common.
    """
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    narrow = groups.join(sized, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(4), "id"), F.col("blocks")).cast("int"))
    narrow = narrow.select(F.col("id").alias("doc_id"), F.col("component").alias("group"), "size", "blocks", "block")
    # The ids grow with the input: a sort-merge join at every size, never a broadcast that fits small inputs only.
    out = rows.join(narrow.hint("merge"), "doc_id").select(F.col("doc_id").alias("rep"), "group", "size", "blocks", "block", "text")
    return scratch.table(out, "texts")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, each of left with each of right, by products of membership matrices."""
    flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    rows, cols = [], []
    for x, f in zip((left, right), flat):
        at = np.searchsorted(common, f)
        hit = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == f) if len(common) else np.zeros(len(f), bool)
        rows.append(np.repeat(np.arange(len(x)), [len(s) for s in x])[hit])
        cols.append(at[hit])
    for c in range(0, len(common), COLUMNS):
        m = []
        for k, x in enumerate((left, right)):
            here = (cols[k] >= c) & (cols[k] < c + COLUMNS)
            a = np.zeros((len(x), min(COLUMNS, len(common) - c)), np.float32)
            a[rows[k][here], cols[k][here] - c] = 1
            m.append(a)
        out += (m[0] @ m[1].T).astype(np.int64)  # counts below 2^24 are exact
    return out


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right, or within left (right None): positions, right ones behind left's."""
    other = left if right is None else right
    n = overlaps(left, other)
    size, size_ = (np.array([len(s) for s in x], dtype=np.int64) for x in (left, other))
    hit = (100 * n >= percent * (size[:, None] + size_[None, :] - n)) & (n > 0)
    shift = 0 if right is None else len(left)
    group = np.arange(len(left) + (len(other) if shift else 0))
    out = []
    for i, j in np.argwhere(hit).tolist():
        if group[i] != group[j + shift]:
            out.append((i, j + shift))
            group[group == group[j + shift]] = group[i]
    return out


def _confirm(texts: DataFrame, edges: DataFrame, groups: DataFrame, scratch: Scratch, words: int, percent: int, block: int, grid: int) -> DataFrame:
    """Confirmed links (a, b) that connect what the groups' links and candidates connect."""
    # A block meets itself, and in groups of up to `grid` classes every other block: at most grid / block copies of a text.
    others = F.when(F.col("size") <= grid, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    confirmed = scratch.table(_blockwise(texts, others, words, percent, block), "confirmed-0")
    large = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > grid).select("component")
    if large.isEmpty():
        return confirmed
    unsettled = groups.join(large, "component").select(F.col("id").alias("a"))
    edges = edges.join(unsettled, "a", "left_semi")
    left = edges
    for turn in (1, 2, 3):
        now = components(confirmed, scratch, f"confirmed-cc-{turn}")
        ends = left.join(now.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(now.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        ends = ends.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
        left = scratch.table(ends.select("a", "b", "weight", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")), f"left-{turn}")
        if left.isEmpty():
            break
        if turn < 3:
            best = Window.partitionBy("ca", "cb").orderBy(F.desc("weight"), "a", "b")
            chosen = scratch.table(left.withColumn("n", F.row_number().over(best)).filter("n = 1").select("a", "b"), f"chosen-{turn}")
            left = left.select("a", "b", "weight").join(chosen, ["a", "b"], "left_anti")
        else:
            chosen = left.select("a", "b")
        confirmed = confirmed.unionByName(_pairwise(chosen, texts, scratch, words, percent, f"confirmed-{turn}"))
    now = components(confirmed, scratch, "confirmed-cc-last")
    chosen, dense = _sharing_rare(texts.filter(F.col("size") > grid), now, scratch, words, percent)
    confirmed = confirmed.unionByName(_pairwise(chosen, texts, scratch, words, percent, "confirmed-last"))
    # Where sharing pairs are about as many as all pairs, products of blocks are the cheaper way, by far.
    sizes = texts.join(dense, "group").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = scratch.table(sizes.select("group", F.greatest(F.ceil(F.col("n") / LARGE_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "dense")
    again = texts.drop("blocks", "block").join(sizes, "group").withColumn("block", F.pmod(F.xxhash64(F.lit(6), "rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    return confirmed.unionByName(scratch.table(_blockwise(again, every, words, percent, LARGE_BLOCK), "confirmed-dense"))


def _blockwise(texts: DataFrame, others: Column, words: int, percent: int, block: int) -> DataFrame:
    """Spanning links (a, b) of each pair of blocks (block, one of others) of a group, all of whose sets are compared."""
    met = texts.withColumn("other", F.explode(others)).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "text")

    def check(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        at, ids = t["block"].to_numpy(), t["rep"].to_numpy()
        held = [shingles(x.as_py(), words) for x in t["text"]]
        first, second = np.flatnonzero(at == i), np.flatnonzero(at == j)
        where, pairs = first, []
        if i == j:
            # A block of a large group may hold more than its share: it is taken in parts.
            cut = [first[k : k + 2 * block] for k in range(0, len(first), 2 * block)]
            for p in range(len(cut)):
                for q in range(p, len(cut)):
                    both = cut[p] if p == q else np.concatenate((cut[p], cut[q]))
                    found = spanning_links([held[x] for x in cut[p]], None if p == q else [held[x] for x in cut[q]], percent)
                    pairs += [(both[x], both[y]) for x, y in found]
        elif len(first) and len(second):
            where = np.concatenate((first, second))
            pairs = [(where[x], where[y]) for x, y in spanning_links([held[x] for x in first], [held[x] for x in second], percent)]
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(ids[y]) for _, y in pairs], pa.int64())})

    return met.groupBy("group", "i", "j").applyInArrow(check, "a long, b long")


def _pairwise(chosen: DataFrame, texts: DataFrame, scratch: Scratch, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of chosen that are links."""
    pairs = chosen.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            keep = pa.array([linked(shingles(x.as_py(), words), shingles(y.as_py(), words), percent) for x, y in zip(p["x"], p["y"])], pa.bool_())
            yield p.select(["a", "b"]).filter(keep)

    return scratch.table(pairs.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), name)


def rarest(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, by frequency and hash, one of which it shares with each set that it links to."""
    n = len(hashes)
    times = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        times = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, times))[: n + 1 + -percent * n // 100]]


def _sharing_rare(texts: DataFrame, now: DataFrame, scratch: Scratch, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a group, not connected in now, that sizes and shared rare shingles do not rule out as links; and groups of which there are
    too many to be looked at one by one, whose pairs are left out."""
    share = F.lit(SAMPLED / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1_000_000)) / F.lit(1e6) < share).select("text")

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for t in x["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], names=["token"])

    counted = sample.mapInArrow(all_, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()  # bounded; any order would do, this one makes few pairs
    frequent, counts = np.array([r["token"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    counts, frequent = counts[np.argsort(frequent)], np.sort(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for group, rep, t in zip(x["group"].to_pylist(), x["rep"].to_pylist(), x["text"]):
                held = shingles(t.as_py(), words)
                token = rarest(held, frequent, counts, percent)
                k = len(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, group)), pa.array(np.full(k, rep)), pa.array(token.view(np.int64)), pa.array(np.arange(k)), pa.array(np.full(k, len(held)))], names=["group", "rep", "token", "place", "n"])

    held = scratch.table(texts.select("group", "rep", "text").mapInArrow(prefixes, "group long, rep long, token long, place long, n long"), "rare")
    of = now.select(F.col("id").alias("rep"), "component")
    held = held.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = held.groupBy("group", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("group", "token")
    held = scratch.table(held.join(mixed, ["group", "token"], "left_semi"), "rare-mixed")
    sharing = held.groupBy("group", "token").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("group").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    members = held.groupBy("group").agg(F.count_distinct("rep").cast("double").alias("m"))
    dense = scratch.table(sharing.join(members, "group").filter(F.col("pairs") * PAIR_COST > F.col("m") * F.col("m")).select("group"), "dense-groups")
    held = held.join(dense, "group", "left_anti")
    x, y = held.alias("x"), held.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # At most so many are shared: those before this one, itself, and those behind it.
    most = F.least("x.place", "y.place") + 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1
    met = (F.col("x.group") == F.col("y.group")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    met = met & (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large))
    # A frequent shingle is a hot key of a plain join, whose large partitions Spark splits.
    pairs = x.join(y.hint("merge"), met).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    return scratch.table(pairs.distinct(), "rare-pairs"), dense
