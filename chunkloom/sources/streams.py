"""Sources of byte streams and chunk traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE_SCHEMA = "offset LONG, size LONG, hash DECIMAL(20,0)"
SPREAD_BYTES = 16 << 20  # of a small input's files


def spread(df: DataFrame) -> DataFrame:
    """df for work that costs much more than moving its rows: a small input is dealt evenly, since its files may be one row group.

    A row group is one task, however many splits a file has. Inputs above ``SPREAD_BYTES`` have many; their rows stay where they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def from_text(df: DataFrame, *, id_col: str, text_col: str = "text") -> DataFrame:
    """stream_id, data: the UTF-8 bytes of a text column; null texts have null data."""
    return df.select(F.col(id_col).alias("stream_id"), F.encode(F.col(text_col), "UTF-8").alias("data"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (the path), data, n_bytes of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), F.col("content").alias("data"), F.col("length").alias("n_bytes"))


def from_reader(spark: SparkSession, reader, *, name: str = "-") -> DataFrame:
    """stream_id, data, n_bytes of one byte stream, such as standard input: read to its end on the driver, so it has to fit there."""
    data = reader.read()
    return spark.createDataFrame([(name, bytearray(data), len(data))], "stream_id string, data binary, n_bytes long")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Chunk trace: one line `offset size hash` for each chunk, the hash an unsigned 64-bit number."""
    return spark.read.schema(TRACE_SCHEMA).option("sep", " ").csv(path)


def write_trace(chunks: DataFrame, path: str, *, stream_id=None) -> None:
    """Trace of one stream's chunks (offset, size, hash as DECIMAL(20,0)), in order."""
    one = chunks if stream_id is None else chunks.filter(F.col("stream_id") == stream_id)
    one.select("offset", "size", F.col("hash").cast("decimal(20,0)").alias("hash")).orderBy("offset").write.mode("overwrite").option("sep", " ").csv(path)


def trace_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Position by position: place, and offset, size and hash of both, where the traces of one stream differ; null where one has ended.

    Chunks of a stream have different offsets, so a place is the number of chunks that start before: rows are numbered by ranges of offsets.
    """
    def placed(trace: DataFrame, side: str) -> DataFrame:
        page = trace.withColumn("page", F.floor(F.col("offset") / (1 << 26)))  # one row for each 64 MiB of the stream
        before = page.groupBy("page").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("page").orderBy("offset"))
        return page.withColumn("inside", inside).join(before.drop("n"), "page").select((F.col("before") + F.col("inside") - 1).alias("place"), F.struct("offset", "size", "hash").alias(side))

    both = placed(expected, "expected").join(placed(actual, "actual"), "place", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select("place", "expected", "actual")


def compare_traces(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either trace that the other lacks, with side and count; empty if they agree."""
    left, right = expected.exceptAll(actual).withColumn("side", F.lit("expected")), actual.exceptAll(expected).withColumn("side", F.lit("actual"))
    return left.unionByName(right)
