"""Duplicate chunks: summaries, indexes, latest earlier instances, dictionary windows, membership, positions.

Chunks are rows (stream_id, chunk_i, offset, size, hash). Nothing here gathers a hash's instances: a hash may be that of a
third of all chunks, so first instances come from partial minima and windows are by stream and hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 1024


def running_total(rows: DataFrame, order: str, amount: str, out: str, page: int = PAGE) -> DataFrame:
    """rows (order: unique non-negative long) with the sum of amount over all rows before, in two levels.

    Pages of `page` numbers are summed by themselves; one task sees a row per page only.
    """
    paged = rows.withColumn("_page", F.floor(F.col(order) / page))
    pages = paged.groupBy("_page").agg(F.sum(amount).alias("_sum"))
    pages = pages.withColumn("_before", F.sum("_sum").over(Window.orderBy("_page")) - F.col("_sum")).drop("_sum")
    inside = F.sum(amount).over(Window.partitionBy("_page").orderBy(order)) - F.col(amount)
    return paged.withColumn("_inside", inside).join(pages, "_page").withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_page", "_before", "_inside")


def first_instances(chunks: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per hash: its first stream_id, offset, chunk_i, size, and the number of instances n."""
    first = F.min(F.struct("stream_id", "offset", "chunk_i", "size", *extra)).alias("f")
    return chunks.groupBy("hash").agg(first, F.count(F.lit(1)).alias("n")).select("hash", "f.*", "n")


def dedup_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, unique_chunks, total_bytes, dup_bytes, der (total / (total - duplicates); 1 for no bytes)."""
    per_hash = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    total, once = F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    out = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), total.cast("long").alias("total_bytes"), (total - once).cast("long").alias("dup_bytes"))
    return out.withColumn("der", F.round(F.coalesce(F.try_divide(F.col("total_bytes"), F.col("total_bytes") - F.col("dup_bytes")), F.lit(1.0)), 6))


def dedup_by(chunks: DataFrame, key: str) -> DataFrame:
    """Per value of key: chunks, total_bytes and dup_bytes; a chunk is a duplicate if an earlier stream or position has it."""
    all_ = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("total_bytes"))
    once = first_instances(chunks, [key]).groupBy(key).agg(F.sum("size").alias("once"))
    out = all_.join(once, all_[key].eqNullSafe(once[key]), "left").select(all_[key], "chunks", "total_bytes", (F.col("total_bytes") - F.coalesce("once", F.lit(0))).alias("dup_bytes"))
    return out


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Both averages in use: of all chunks, and bytes left after deduplication for each chunk."""
    s = dedup_summary(chunks).drop("der")
    sizes = chunks.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    return s.join(F.broadcast(sizes)).select(  # one row each
        "chunks", "unique_chunks", "min_size", "max_size",
        F.round(F.try_divide("total_bytes", "chunks"), 6).alias("real_avg_size"),
        F.round(F.try_divide(F.col("total_bytes") - F.col("dup_bytes"), F.col("chunks")), 6).alias("avg_after_dedup"),
    )


def chunk_index(chunks: DataFrame) -> DataFrame:
    """hash, chunk_id (dense, in order of first instances), n, stream_id and offset of the first instance."""
    firsts = first_instances(chunks)
    per_stream = running_total(firsts.groupBy("stream_id").agg(F.count(F.lit(1)).alias("k")), "stream_id", "k", "before")
    inside = F.row_number().over(Window.partitionBy("stream_id").orderBy("offset"))
    return firsts.withColumn("inside", inside).join(per_stream, "stream_id").select("hash", (F.col("before") + F.col("inside") - 1).cast("long").alias("chunk_id"), "n", "stream_id", "offset")


def latest_earlier(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """chunks with prev_offset: the latest equal chunk of the stream before it, if not further back than limit."""
    w = Window.partitionBy("stream_id", "hash").orderBy("offset")
    prev = F.lag("offset").over(w)
    return chunks.withColumn("prev_offset", prev if limit is None else F.when(F.col("offset") - prev <= limit, prev))


def instances_in_window(chunks: DataFrame, limit: int) -> DataFrame:
    """chunks with n_usable: equal chunks of the stream at most limit bytes before."""
    w = Window.partitionBy("stream_id", "hash").orderBy("offset").rangeBetween(-limit, -1)
    return chunks.withColumn("n_usable", F.count(F.lit(1)).over(w))


def unique_only_window(chunks: DataFrame) -> DataFrame:
    """chunks with dict_used: bytes of first instances before them in their stream (duplicates cost nothing)."""
    own = F.when(F.row_number().over(Window.partitionBy("stream_id", "hash").orderBy("offset")) == 1, F.col("size")).otherwise(F.lit(0))
    marked = chunks.withColumn("_own", own)
    used = F.sum("_own").over(Window.partitionBy("stream_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("dict_used", F.coalesce(used, F.lit(0)).cast("long")).drop("_own")


def duplicates(chunks: DataFrame) -> DataFrame:
    """Chunks that stand earlier somewhere, as a semi join with the repeated hashes' later instances."""
    f = first_instances(chunks).filter("n > 1").select(F.col("hash").alias("h"), F.struct("stream_id", "offset").alias("first"))
    return chunks.join(f, (F.col("hash") == F.col("h")) & (F.struct("stream_id", "offset") > F.col("first")), "left_semi")


def first_only(chunks: DataFrame) -> DataFrame:
    f = first_instances(chunks).filter("n > 1").select(F.col("hash").alias("h"), F.struct("stream_id", "offset").alias("first"))
    return chunks.join(f, (F.col("hash") == F.col("h")) & (F.struct("stream_id", "offset") > F.col("first")), "left_anti")


def found_in(chunks: DataFrame, others: DataFrame) -> DataFrame:
    """Chunks whose hash is one of others'."""
    return chunks.join(others.select("hash").distinct(), "hash", "left_semi")


def chunk_at(probes: DataFrame, chunks: DataFrame, page: int = PAGE) -> DataFrame:
    """probes (stream_id, at) with chunk_i and pos: the chunk that holds byte `at`, and the place in it.

    A range join as an equi-join: chunks are entered under each page of offsets that they touch.
    """
    first, last = F.floor(F.col("offset") / page), F.floor((F.col("offset") + F.col("size") - 1) / page)
    entered = chunks.withColumn("_page", F.explode(F.sequence(first, last)))
    asked = probes.withColumn("_page", F.floor(F.col("at") / page))
    inside = (F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col("size"))
    return asked.join(entered, ["stream_id", "_page"]).filter(inside).select("stream_id", "at", "chunk_i", (F.col("at") - F.col("offset")).alias("pos"))


def copy_insert_plan(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """stream_id, seq, type (COPY or INSERT), out_offset, src_offset, size: one instruction for each chunk."""
    prev = latest_earlier(chunks, limit)
    kind = F.when(F.col("prev_offset").isNotNull(), "COPY").otherwise("INSERT")
    return prev.select("stream_id", F.col("chunk_i").alias("seq"), kind.alias("type"), F.col("offset").alias("out_offset"), F.coalesce("prev_offset", "offset").alias("src_offset"), "size")


def coalesce_plan(plan: DataFrame) -> DataFrame:
    """Adjacent instructions of one type whose sources are adjacent become one (gaps and islands)."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    joins = (F.lag("type").over(w) == F.col("type")) & (F.lag(F.col("src_offset") + F.col("size")).over(w) == F.col("src_offset"))
    island = F.sum(F.when(joins, 0).otherwise(1)).over(w)
    out = plan.withColumn("island", island).groupBy("stream_id", "island")
    return out.agg(F.min("type").alias("type"), F.min("out_offset").alias("out_offset"), F.min("src_offset").alias("src_offset"), F.sum("size").alias("size")).select("stream_id", F.col("island").alias("seq"), "type", "out_offset", "src_offset", "size")


def omit_small(plan: DataFrame, below: int) -> DataFrame:
    """A copy shorter than `below` that an insert follows becomes an insert, as does one between inserts."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    small = (F.col("type") == "COPY") & (F.col("size") < below) & (F.lead("type").over(w) == "INSERT")
    return plan.withColumn("omitted", F.coalesce(small, F.lit(False))).withColumns({"type": F.when(F.col("omitted"), "INSERT").otherwise(F.col("type")), "src_offset": F.when(F.col("omitted"), F.col("out_offset")).otherwise(F.col("src_offset"))})


def plan_savings(plan: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    copied = lambda c: F.coalesce(F.sum(F.when(F.col("type") == "COPY", c)), F.lit(0)).cast("long")
    return plan.groupBy(*key).agg(F.count(F.lit(1)).alias("instructions"), copied(F.lit(1)).alias("copies"), copied(F.col("size")).alias("saved_bytes"), F.sum("size").cast("long").alias("total_bytes"))


def within_time(events: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> Column:
    """Whether the same key stood at most so many seconds before: the dictionary window in the domain of time."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))  # noqa: E731  also of times without a zone
    return F.coalesce(micros(F.col(ts)) - micros(F.lag(ts).over(w)) <= seconds * 1_000_000, F.lit(False))
