"""Sharding: two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of the record's id and its place in the
scan; the buckets are Spark's shuffle files. Pass 2 takes one bucket at a time into memory, puts it in a canonical order,
Fisher-Yates shuffles it and writes it. The position of a record in the whole order is its bucket's offset plus its place
in the bucket; shard and slot are that position's remainder and quotient, so the counts of any two shards differ by one at
most (law ``rows``), whatever the sizes of texts or the number of copies.

No bucket depends on a key's frequency: a hot source or a group of copies is scattered like any other record. A bucket
holds ``bucket_bytes`` on average; there are at most ``MAX_BUCKETS``, so beyond their product (4 TB) buckets grow with the input, to 100 MB at 100 TB. So
the offsets, one row per bucket, have a proven bound and are broadcast (about 24 MB at most). Tasks of the shuffle grow in number with the input.

Defined results. Null texts have size 1 and the crc32 of no bytes; a null doc_id, repeated doc_ids and wholly repeated
rows are records like others; extra columns travel along, but those called bucket, place, shard or slot give way to the
shuffle's; an empty table gives empty shards. The order is a function of seed, table and file splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm._common import Scratch

BUCKET_BYTES = 4 << 20  # raw bytes of text in a bucket
MIN_BUCKETS = 128  # so that small tables use the cluster, too
MAX_BUCKETS = 1 << 20
TASK_BYTES = 64 << 20  # raw bytes of text that a task of the shuffle takes in
SEED = 20_24


def external_shuffle(docs: DataFrame, *, n_shards: int = 16, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """All columns of docs and bucket, place, shard (int) and slot (long); the records lie written in the shared folder."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("bucket", "place", "shard", "slot", "_ordinal")))
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    n_buckets = min(MAX_BUCKETS, max(min_buckets, -(-total // bucket_bytes)))
    tasks = min(n_buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
    ordinal = F.monotonically_increasing_id()  # file split and row in it: tells repeated rows apart
    dealt = docs.withColumn("_ordinal", ordinal).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_ordinal")), F.lit(n_buckets)))
    schema = T.StructType([*docs.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType())])

    columns = docs.columns

    def fisher_yates(key: tuple, bucket: pa.Table) -> pa.Table:
        number = key[0].as_py()
        # Arrival order differs from run to run; the ordinal gives one order to start from.
        start = np.argsort(bucket["_ordinal"].to_numpy(), kind="stable")
        order = start[np.random.Generator(np.random.PCG64([seed, number])).permutation(len(start))]
        out = bucket.select(columns).take(pa.array(order))
        n = len(order)
        return out.append_column("bucket", pa.array(np.full(n, number, dtype=np.int64))).append_column("place", pa.array(np.arange(n, dtype=np.int64)))

    scratch = Scratch(docs.sparkSession, "shards")
    buckets = scratch.table(dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(fisher_yates, schema), "buckets")
    # One row per bucket, at most MAX_BUCKETS, summed up in order.
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = offsets(counts)
    at = F.col("before") + F.col("place")
    return buckets.join(F.broadcast(before), "bucket").select(*docs.columns, "bucket", "place", (at % n_shards).cast("int").alias("shard"), F.floor(at / F.lit(n_shards)).cast("long").alias("slot"))


def offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket, by two levels of sums so that no task sorts all buckets at once.

    Buckets are cut into pages of 1,024; the pages' sums (a thousandth of the buckets) are the only rows in one task.
    """
    from pyspark.sql import Window

    paged = counts.withColumn("page", F.floor(F.col("bucket") / 1024))
    pages = paged.groupBy("page").agg(F.sum("n").alias("page_n"))
    pages = pages.withColumn("page_before", F.sum("page_n").over(Window.orderBy("page")) - F.col("page_n"))
    inside = Window.partitionBy("page").orderBy("bucket")
    return paged.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(pages), "page").select("bucket", (F.col("page_before") + F.col("inside")).alias("before"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; rows of a folder's files carry their slot, which is the order to read them in."""
    shuffled.drop("bucket", "place").write.partitionBy("shard").option("compression", "zstd").parquet(path)
