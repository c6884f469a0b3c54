"""The engine's registered queries, each with the SQL that a second engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.config import COMPRESS, LARGE, ChunkConfig, PlanConfig
from chunkloom.functions import bits, gear
from chunkloom.operators import chunking, dedup, delta, resemblance
from chunkloom.sources import container
from chunkloom.sources import streams as sources
from chunkloom.sources.streams import compare_traces, from_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLOCK = 256  # fixed chunks of the analytic queries
PIECE = 64  # finer ones for matches across tables
LIMIT = 4096  # dictionary of the windowed queries, in bytes


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """stream_id, data and more columns of documents."""
    docs = sources.spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("data"), *extra)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly for work that costs far more than moving the bytes: a file's row group may be one task's otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id")


def as_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("stream_id", "doc_id")


def fixed(spark: SparkSession, sf_dir: str, *extra: str, with_data: bool = False) -> DataFrame:
    return chunking.fixed_chunks(streams(spark, sf_dir, *extra), BLOCK, keep=["stream_id", *extra], with_data=with_data)


# ---------------------------------------------------------------- SQL building blocks

BYTES_SQL = """
gears AS MATERIALIZED (SELECT list(('0x' || substr(md5(b::VARCHAR), 1, 8))::BIGINT ORDER BY b) AS g FROM range(256) t(b)),
hexed AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(hx, '..')) AS b, unnest(range(n)) AS i FROM hexed),
h0 AS (SELECT doc_id, i, g[('0x' || b)::INT + 1] AS h FROM bytes, gears),
h1 AS (SELECT doc_id, i, (h + 2 * coalesce(lag(h, 1) OVER w, 0)) % 4294967296 AS h FROM h0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h2 AS (SELECT doc_id, i, (h + 4 * coalesce(lag(h, 2) OVER w, 0)) % 4294967296 AS h FROM h1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h3 AS (SELECT doc_id, i, (h + 16 * coalesce(lag(h, 4) OVER w, 0)) % 4294967296 AS h FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT doc_id, i, (h + 256 * coalesce(lag(h, 8) OVER w, 0)) % 4294967296 AS h FROM h3 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h5 AS (SELECT doc_id, i, (h + 65536 * coalesce(lag(h, 16) OVER w, 0)) % 4294967296 AS h FROM h4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
"""


def candidates_sql(cfg: ChunkConfig) -> str:
    return BYTES_SQL + f"cand AS MATERIALIZED (SELECT doc_id, i, h FROM h5 WHERE h < {cfg.easiest})\n"


def type_sql(cfg: ChunkConfig) -> str:
    return f"CASE WHEN h < {cfg.threshold('hard')} THEN 'H' WHEN h < {cfg.threshold('easy')} THEN 'E' ELSE 'B' END"


def cuts_sql(cfg: ChunkConfig) -> str:
    """CTEs up to chunks(doc_id, chunk_i, offset, size, hash)."""
    hard = cfg.threshold("hard" if cfg.normalized else "medium")
    easy = cfg.threshold("easy" if cfg.normalized else "medium")
    backup = f"list_filter(a, lambda x: x >= p + {cfg.avg_size} AND x < p + {cfg.max_size})[1]" if cfg.backup else "NULL"
    return "WITH RECURSIVE " + candidates_sql(cfg) + f""",
found AS (SELECT doc_id, list(i ORDER BY i) FILTER (WHERE h < {hard}) AS hd, list(i ORDER BY i) FILTER (WHERE h < {easy}) AS ea, list(i ORDER BY i) AS a FROM cand GROUP BY doc_id),
docs AS MATERIALIZED (SELECT doc_id, n, coalesce(hd, []) AS hd, coalesce(ea, []) AS ea, coalesce(a, []) AS a FROM hexed LEFT JOIN found USING (doc_id)),
steps AS (
  SELECT doc_id, n, 0::BIGINT AS k, 0::BIGINT AS p, 0::BIGINT AS size FROM docs
  UNION ALL
  SELECT doc_id, n, k + 1, q, q - p FROM (
    SELECT s.doc_id, s.n, s.k, s.p, coalesce(
      list_filter(hd, lambda x: x >= p + {cfg.min_size} AND x < least(p + {cfg.avg_size}, s.n))[1],
      list_filter(ea, lambda x: x >= p + {cfg.avg_size} AND x < least(p + {cfg.max_size}, s.n))[1],
      CASE WHEN s.n - p < {cfg.max_size} THEN s.n END,
      {backup}, p + {cfg.max_size}) AS q
    FROM steps s JOIN docs d ON d.doc_id = s.doc_id WHERE p < s.n)),
chunks AS MATERIALIZED (
  SELECT s.doc_id, k - 1 AS chunk_i, p - size AS "offset", size, md5(unhex(substr(hx, (2 * (p - size) + 1)::BIGINT, (2 * size)::BIGINT))) AS hash
  FROM steps s JOIN hexed x ON x.doc_id = s.doc_id WHERE k > 0)
"""


def blocks_sql(name: str = "fixed", source: str = "documents", key: str = "doc_id", text: str = "text", size: int = BLOCK, extra: str = "") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, {extra} (o // {size})::BIGINT AS chunk_i, o::BIGINT AS "offset", least({size}, n - o)::BIGINT AS size, substr(hx, (2 * o + 1)::BIGINT, {2 * size}) AS part, md5(unhex(substr(hx, (2 * o + 1)::BIGINT, {2 * size}))) AS hash
  FROM (SELECT *, hex(encode({text})) AS hx, octet_length(encode({text})) AS n, unnest(range(0, octet_length(encode({text})), {size})) AS o FROM {source}))
"""


FIXED = "WITH " + blocks_sql()
CHUNK_COLUMNS = 'doc_id, chunk_i, "offset", size, hash'


def cdc(spark: SparkSession, sf_dir: str, cfg: ChunkConfig = COMPRESS, *extra: str) -> DataFrame:
    return chunking.cdc_chunks(streams(spark, sf_dir, *extra), cfg, keep=["stream_id", *extra])


# ---------------------------------------------------------------- chunking


@query(cuts_sql(COMPRESS) + f"SELECT {CHUNK_COLUMNS} FROM chunks")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(cdc(spark, sf_dir))


@query(cuts_sql(COMPRESS.with_(normalized=False)) + f"SELECT {CHUNK_COLUMNS} FROM chunks")
def cdc_chunks_no_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(cdc(spark, sf_dir, COMPRESS.with_(normalized=False)))


@query(cuts_sql(COMPRESS.with_(backup=False)) + f"SELECT {CHUNK_COLUMNS} FROM chunks")
def cdc_chunks_no_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(cdc(spark, sf_dir, COMPRESS.with_(backup=False)))


@query(cuts_sql(LARGE) + f"SELECT {CHUNK_COLUMNS} FROM chunks")
def cdc_chunks_8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(cdc(spark, sf_dir, LARGE))


@query(cuts_sql(COMPRESS) + 'SELECT doc_id, chunk_i, "offset", size FROM chunks')
def cdc_chunks_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cuts from segments of 1,000 bytes."""
    return as_doc(chunking.cuts_of_segments(chunking.segments(streams(spark, sf_dir), 1000)))


@query(
    "WITH RECURSIVE " + candidates_sql(COMPRESS.with_(backup=False, normalized=False)) + f""",
docs AS MATERIALIZED (SELECT x.doc_id, n, coalesce(list(i ORDER BY i) FILTER (WHERE i IS NOT NULL AND i < n), []) AS a FROM hexed x LEFT JOIN cand c ON c.doc_id = x.doc_id GROUP BY x.doc_id, n),
steps AS (
  SELECT doc_id, n, 0::BIGINT AS k, 0::BIGINT AS p, 0::BIGINT AS size FROM docs
  UNION ALL
  SELECT doc_id, n, k + 1, q, q - p FROM (
    SELECT s.doc_id, s.n, s.k, s.p, coalesce(list_filter(a, lambda x: x >= p + {COMPRESS.min_size} AND x <= p + {COMPRESS.max_size})[1], least(p + {COMPRESS.max_size}, s.n)) AS q
    FROM steps s JOIN docs d ON d.doc_id = s.doc_id WHERE p < s.n))
SELECT s.doc_id, k - 1 AS chunk_i, p - size AS "offset", size, md5(unhex(substr(hx, (2 * (p - size) + 1)::BIGINT, (2 * size)::BIGINT))) AS hash
FROM steps s JOIN hexed x ON x.doc_id = s.doc_id WHERE k > 0"""
)
def sscdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage cutting by one mask."""
    return as_doc(chunking.two_stage_chunks(streams(spark, sf_dir)))


@query("WITH " + candidates_sql(COMPRESS) + f'SELECT doc_id, i::BIGINT AS "offset", h::BIGINT AS gear, {type_sql(COMPRESS)} AS type FROM cand')
def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(typed_candidates(spark, sf_dir))


def typed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = COMPRESS
    kind = gear.candidate_type(F.col("gear"), c.threshold("hard"), c.threshold("medium"), c.threshold("easy"))
    return chunking.cut_candidates(streams(spark, sf_dir), c).withColumn("type", kind)


@query("WITH " + candidates_sql(COMPRESS) + f"SELECT {type_sql(COMPRESS)} AS type, count(*) AS n, min(i)::BIGINT AS first_offset, max(i)::BIGINT AS last_offset FROM cand GROUP BY 1")
def candidate_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_candidates(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query(
    "WITH " + candidates_sql(COMPRESS) + f""",
typed AS (SELECT doc_id, i, {type_sql(COMPRESS)} AS type FROM cand),
lagged AS (SELECT *, i - lag(i) OVER w AS d, lag(type) OVER w AS prev FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i::BIGINT AS "offset", type, d::BIGINT AS distance, coalesce(prev = 'H' AND d + {COMPRESS.min_size} <= {COMPRESS.max_size} AND ((type = 'H' AND d >= {COMPRESS.min_size}) OR (type = 'E' AND d >= {COMPRESS.avg_size})), false) AS is_invariant FROM lagged"""
)
def chunk_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("offset")
    d = typed_candidates(spark, sf_dir).withColumns({"distance": F.col("offset") - F.lag("offset").over(w), "prev": F.lag("type").over(w)})
    hit = gear.invariant(F.col("prev") == "H", F.col("distance"), F.col("type"), COMPRESS.min_size, COMPRESS.avg_size, COMPRESS.max_size)
    return as_doc(d.select("stream_id", "offset", "type", "distance", hit.alias("is_invariant")))


@query(
    "WITH " + BYTES_SQL.rstrip().rstrip(",") + """
SELECT x.doc_id, (n - 1)::BIGINT AS at, h::BIGINT AS gear, lpad(bin(h), 32, '0') AS digits FROM hexed x JOIN h5 ON h5.doc_id = x.doc_id AND i = n - 1"""
)
def gear_at_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash at every document's last byte."""
    s = streams(spark, sf_dir).filter(F.octet_length("data") > 0).withColumn("at", (F.octet_length("data") - 1).cast("long"))
    h = s.select("stream_id", "at", gear.gear_at(F.col("data"), F.col("at")).alias("gear"))
    return as_doc(h.withColumn("digits", gear.binary_digits(F.col("gear"))))


@query(FIXED + f"SELECT {CHUNK_COLUMNS} FROM fixed")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(fixed(spark, sf_dir))


# ---------------------------------------------------------------- duplicates

SUMMARY_SQL = """
SELECT count(*) AS chunks, count(DISTINCT hash) AS unique_chunks, sum(size)::BIGINT AS total_bytes, sum(CASE WHEN rn > 1 THEN size ELSE 0 END)::BIGINT AS dup_bytes,
  round(sum(size)::DOUBLE / (sum(size) - sum(CASE WHEN rn > 1 THEN size ELSE 0 END)), 6) AS der
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, "offset") AS rn FROM {})"""


@query(cuts_sql(COMPRESS) + SUMMARY_SQL.format("chunks"))
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: content-defined chunks of all documents, duplicate bytes and the elimination ratio."""
    return dedup.dedup_summary(cdc(spark, sf_dir))


def _by_sql(key: str) -> str:
    return "WITH " + blocks_sql(extra="source, lang,") + f"""
SELECT {key}, count(*) AS chunks, sum(size)::BIGINT AS total_bytes, sum(CASE WHEN rn > 1 THEN size ELSE 0 END)::BIGINT AS dup_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, "offset") AS rn FROM fixed) GROUP BY {key}"""


@query(_by_sql("source"))
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_by(fixed(spark, sf_dir, "source"), "source")


@query(_by_sql("lang"))
def dedup_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_by(fixed(spark, sf_dir, "lang"), "lang")


@query(
    cuts_sql(COMPRESS) + """
SELECT count(*) AS chunks, count(DISTINCT hash) AS unique_chunks, min(size)::BIGINT AS min_size, max(size)::BIGINT AS max_size, round(sum(size)::DOUBLE / count(*), 6) AS real_avg_size,
  round(sum(CASE WHEN rn = 1 THEN size ELSE 0 END)::DOUBLE / count(*), 6) AS avg_after_dedup
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, "offset") AS rn FROM chunks)"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.chunk_stats(cdc(spark, sf_dir))


@query(
    FIXED + """
SELECT hash, (row_number() OVER (ORDER BY doc_id, "offset") - 1)::BIGINT AS chunk_id, n, doc_id, "offset"
FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS n, row_number() OVER (PARTITION BY hash ORDER BY doc_id, "offset") AS rn FROM fixed) WHERE rn = 1"""
)
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.chunk_index(fixed(spark, sf_dir)))


@query(FIXED + f'SELECT {CHUNK_COLUMNS}, lag("offset") OVER (PARTITION BY doc_id, hash ORDER BY "offset") AS prev_offset FROM fixed')
def dup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.latest_earlier(fixed(spark, sf_dir)))


@query(
    FIXED + f"""
SELECT doc_id, chunk_i, "offset", size, hash, CASE WHEN "offset" - p <= {LIMIT} THEN p END AS prev_offset FROM (SELECT *, lag("offset") OVER (PARTITION BY doc_id, hash ORDER BY "offset") AS p FROM fixed)"""
)
def dup_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.latest_earlier(fixed(spark, sf_dir), LIMIT))


@query(FIXED + f'SELECT {CHUNK_COLUMNS}, count(*) OVER (PARTITION BY doc_id, hash ORDER BY "offset" RANGE BETWEEN {LIMIT} PRECEDING AND 1 PRECEDING) AS n_usable FROM fixed')
def dup_instances_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.instances_in_window(fixed(spark, sf_dir), LIMIT))


@query(
    FIXED + f"""
SELECT {CHUNK_COLUMNS}, coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dict_used
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, hash ORDER BY "offset") = 1 THEN size ELSE 0 END AS own FROM fixed)"""
)
def dict_unique_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.unique_only_window(fixed(spark, sf_dir)))


@query(FIXED + f'SELECT {CHUNK_COLUMNS} FROM fixed a WHERE EXISTS (SELECT 1 FROM fixed b WHERE b.hash = a.hash AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b."offset" < a."offset")))')
def dup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.duplicates(fixed(spark, sf_dir)).select("stream_id", "chunk_i", "offset", "size", "hash"))


@query(FIXED + f'SELECT {CHUNK_COLUMNS} FROM fixed a WHERE NOT EXISTS (SELECT 1 FROM fixed b WHERE b.hash = a.hash AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b."offset" < a."offset")))')
def unique_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.first_only(fixed(spark, sf_dir)).select("stream_id", "chunk_i", "offset", "size", "hash"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, (sum(octet_length(encode(text))) OVER (ORDER BY doc_id) - octet_length(encode(text)))::BIGINT AS corpus_offset FROM documents")
def corpus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts if all are one stream in the order of doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return dedup.running_total(docs, "doc_id", "n_bytes", "corpus_offset")


PROBES_SQL = ', probes AS (SELECT doc_id, unnest(range(500, octet_length(encode(text)), 1000))::BIGINT AS "at" FROM documents)'


@query(FIXED + PROBES_SQL + ' SELECT p.doc_id, "at", chunk_i, "at" - "offset" AS pos FROM probes p JOIN fixed c ON c.doc_id = p.doc_id AND "at" >= "offset" AND "at" < "offset" + size')
def offset_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir).filter(F.octet_length("data") > 500)
    probes = s.select("stream_id", F.explode(F.sequence(F.lit(500).cast("long"), F.octet_length("data").cast("long") - 1, F.lit(1000).cast("long"))).alias("at"))
    return as_doc(dedup.chunk_at(probes, fixed(spark, sf_dir)))


@query("WITH " + blocks_sql("pieces", size=PIECE) + ", " + blocks_sql("marks", "benchmark", "item_id", size=PIECE) + f"SELECT {CHUNK_COLUMNS} FROM pieces WHERE hash IN (SELECT hash FROM marks)")
def crosstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents that are blocks of a benchmark item, too."""
    marks = chunking.fixed_chunks(from_text(table(spark, sf_dir, "benchmark"), id_col="item_id"), PIECE)
    return as_doc(dedup.found_in(chunking.fixed_chunks(streams(spark, sf_dir), PIECE), marks).select("stream_id", "chunk_i", "offset", "size", "hash"))


@query(
    """SELECT event_id, user_id, event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 86400000000, false) AS is_duplicate FROM events"""
)
def events_dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the same user had an event of the type within a day before."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", dedup.within_time(e, ["user_id", "event_type"], "ts", 86_400).alias("is_duplicate"))


@query(
    FIXED + """, shifted AS (SELECT doc_id, chunk_i, "offset", size, CASE WHEN chunk_i % 7 = 3 THEN md5(hash) ELSE hash END AS hash FROM fixed),
a AS (SELECT doc_id, chunk_i, "offset", size, hash FROM fixed), b AS (SELECT doc_id, chunk_i, "offset", size, hash FROM shifted)
SELECT *, 'expected' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'actual' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def trace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two traces, of which the second has every seventh hash changed."""
    a = fixed(spark, sf_dir)
    b = a.withColumn("hash", F.when(F.col("chunk_i") % 7 == 3, F.md5("hash")).otherwise(F.col("hash")))
    return as_doc(compare_traces(a, b))


# ---------------------------------------------------------------- plans

PLAN_SQL = blocks_sql() + """, plan AS MATERIALIZED (
  SELECT doc_id, chunk_i AS seq, CASE WHEN p IS NOT NULL THEN 'COPY' ELSE 'INSERT' END AS type, "offset" AS out_offset, coalesce(p, "offset") AS src_offset, size
  FROM (SELECT *, lag("offset") OVER (PARTITION BY doc_id, hash ORDER BY "offset") AS p FROM fixed))
"""
ISLANDS_SQL = PLAN_SQL + """, islands AS MATERIALIZED (
  SELECT doc_id, island::BIGINT AS seq, min(type) AS type, min(out_offset) AS out_offset, min(src_offset) AS src_offset, sum(size)::BIGINT AS size FROM (
    SELECT *, sum(CASE WHEN pt = type AND pe = src_offset THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM (
      SELECT *, lag(type) OVER w AS pt, lag(src_offset + size) OVER w AS pe FROM plan WINDOW w AS (PARTITION BY doc_id ORDER BY seq)))
  GROUP BY doc_id, island)
"""


@query("WITH " + PLAN_SQL + "SELECT * FROM plan")
def copy_insert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.copy_insert_plan(fixed(spark, sf_dir)))


@query("WITH " + ISLANDS_SQL + "SELECT * FROM islands")
def plan_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.coalesce_plan(dedup.copy_insert_plan(fixed(spark, sf_dir))))


@query("WITH " + ISLANDS_SQL + "SELECT doc_id, count(*) AS instructions, count(*) FILTER (WHERE type = 'COPY') AS copies, coalesce(sum(size) FILTER (WHERE type = 'COPY'), 0)::BIGINT AS saved_bytes, sum(size)::BIGINT AS total_bytes FROM islands GROUP BY doc_id")
def plan_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.plan_savings(dedup.coalesce_plan(dedup.copy_insert_plan(fixed(spark, sf_dir))), ["stream_id"]))


@query(
    "WITH " + ISLANDS_SQL + """
SELECT doc_id, seq, CASE WHEN small THEN 'INSERT' ELSE type END AS type, out_offset, CASE WHEN small THEN out_offset ELSE src_offset END AS src_offset, size, small AS omitted
FROM (SELECT *, coalesce(type = 'COPY' AND size < 512 AND lead(type) OVER (PARTITION BY doc_id ORDER BY seq) = 'INSERT', false) AS small FROM islands)"""
)
def small_match_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(dedup.omit_small(dedup.coalesce_plan(dedup.copy_insert_plan(fixed(spark, sf_dir))), 512))


@query("""SELECT doc_id, v, (CASE WHEN v < 128 THEN 1 WHEN v < 16512 THEN 2 WHEN v < 2113664 THEN 3 WHEN v < 270549120 THEN 4 ELSE 5 END)::BIGINT AS n_bytes
FROM (SELECT doc_id, (octet_length(encode(text)) * (1 + doc_id % 5000))::BIGINT AS v FROM documents)""")
def vli_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.octet_length("text") * (1 + F.col("doc_id") % 5000)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).withColumn("n_bytes", bits.vli_size(F.col("v")))


@query()
def lz_plan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of the full plan: duplicates, deltas, match extension, omission."""
    return as_doc(container.instructions(container.compress(spread(streams(spark, sf_dir)))))


@query()
def container_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document's container and the plan's statistics."""
    c = container.compress(spread(streams(spark, sf_dir)))
    return as_doc(c.withColumn("container", F.octet_length("container").cast("long")).withColumnRenamed("container", "container_bytes"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS covered, true AS gapless, true AS reads_back FROM documents WHERE text IS NOT NULL AND text <> ''")
def lz_plan_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's plan: the bytes that it covers, without gap or overlap, and whether copies read what was there before."""
    i = lz_plan_full(spark, sf_dir)
    gapless = (F.min("out_offset") == 0) & (F.max(F.col("out_offset") + F.col("size")) == F.sum("size")) & (F.count_distinct("out_offset") == F.count(F.lit(1)))
    return i.groupBy("doc_id").agg(F.sum("size").alias("covered"), gapless.alias("gapless"), F.bool_and((F.col("type") == "INSERT") | (F.col("src_offset") < F.col("out_offset"))).alias("reads_back"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS total_bytes, true AS adds_up, true AS bounded FROM documents WHERE text IS NOT NULL")
def container_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's container: literals and copies add up to its bytes, and its size is the literals' and at most 12 bytes an instruction."""
    c = container.compress(spread(streams(spark, sf_dir))).filter("container IS NOT NULL")
    size, literal = F.octet_length("container") - 13, F.col("total_bytes") - F.col("saved_bytes")
    bounded = (size >= literal) & (size <= literal + 12 * F.col("instructions"))
    return as_doc(c.select("stream_id", "total_bytes", ((literal >= 0) & (F.col("deduped_bytes") <= F.col("dup_bytes")) & (F.col("deduped_bytes") <= F.col("saved_bytes"))).alias("adds_up"), bounded.alias("bounded")))


@query("SELECT doc_id, md5(encode(text)) AS md5 FROM documents")
def roundtrip_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded with all features and decoded again."""
    cfg = PlanConfig(generalized=True, features=True, window=4, try_all=True, exhaustive_adjacency=True)
    return as_doc(container.decompress(container.compress(spread(streams(spark, sf_dir)), cfg), digest_only=True).select("stream_id", "md5"))


ARCHIVE = 500  # doc_ids whose documents of one source make an archive: so its size does not grow with the source


@query(f"SELECT source, doc_id // {ARCHIVE} AS archive, md5(encode(string_agg(text, chr(10) ORDER BY doc_id))) AS md5 FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def roundtrip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, archived as streams with a dictionary of 64 KiB: encoded, decoded, digest."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("archive", F.floor(F.col("doc_id") / ARCHIVE).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    s = docs.groupBy("source", "archive").agg(F.encode(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), "UTF-8").alias("data"))
    c = container.compress(s, PlanConfig(dictionary=64 << 10), keep=["source", "archive"])
    return container.decompress(c, keep=["source", "archive"], digest_only=True).select("source", "archive", "md5")


# ---------------------------------------------------------------- resemblance

HALVES = ("('0x' || substr(b, 1, 8))::BIGINT", "('0x' || substr(b, 9, 8))::BIGINT")
MAJORITY = lambda c: " + ".join(f"(CASE WHEN sum(2 * (({c} >> {k}) & 1) - 1) > 0 THEN {1 << k} ELSE 0 END)" for k in range(32))


def simhash_sql(keys: str, source: str) -> str:
    return f"SELECT {keys}, ({MAJORITY('hi')})::BIGINT AS simhash_hi, ({MAJORITY('lo')})::BIGINT AS simhash_lo FROM (SELECT *, {HALVES[0].replace('b,', 'hash,')} AS hi, {HALVES[1].replace('b,', 'hash,')} AS lo FROM {source}) GROUP BY {keys}"


def halves(h) -> tuple:
    return tuple(F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9))


@query("WITH " + blocks_sql("blocks", size=16) + simhash_sql("doc_id", "blocks"))
def simhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each document over its 16-byte blocks, with built-in functions only."""
    b = chunking.fixed_chunks(streams(spark, sf_dir), 16)
    hi, lo = halves(F.col("hash"))
    high, low = resemblance.simhash_aggregate(F.col("hi"), F.col("lo"))
    return as_doc(b.select("stream_id", hi.alias("hi"), lo.alias("lo")).groupBy("stream_id").agg(high.alias("simhash_hi"), low.alias("simhash_lo")))


def block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash (lsh) of each fixed chunk over its 16-byte blocks."""
    b = chunking.fixed_chunks(streams(spark, sf_dir), 16)
    hi, lo = halves(F.col("hash"))
    high, low = resemblance.simhash_aggregate(F.col("hi"), F.col("lo"))
    c = b.select("stream_id", F.floor(F.col("offset") / BLOCK).cast("long").alias("chunk_i"), hi.alias("hi"), lo.alias("lo")).groupBy("stream_id", "chunk_i").agg(high.alias("h"), low.alias("l"))
    return c.select("stream_id", "chunk_i", F.shiftleft("h", 32).bitwiseOR(F.col("l")).alias("lsh"), "h", "l")


LSH_SQL = "WITH " + blocks_sql("blocks", size=16) + ', lsh AS MATERIALIZED (' + simhash_sql("doc_id, chunk_i", f'(SELECT doc_id, ("offset" // {BLOCK})::BIGINT AS chunk_i, hash FROM blocks)').replace("simhash_hi", "h").replace("simhash_lo", "l") + ")"
PAIRS_SQL = LSH_SQL + """, pairs AS MATERIALIZED (SELECT a.doc_id, a.chunk_i, b.chunk_i AS similar_i, (bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)))::BIGINT AS distance
  FROM lsh a JOIN lsh b ON a.doc_id = b.doc_id AND b.chunk_i BETWEEN a.chunk_i - 4 AND a.chunk_i - 1)
"""


@query(PAIRS_SQL + "SELECT * FROM pairs WHERE distance <= 32")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(resemblance.previous_similar(block_hashes(spark, sf_dir), 4, 32))


@query(PAIRS_SQL + "SELECT doc_id, chunk_i, similar_i, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_i ORDER BY distance, similar_i DESC) AS n FROM pairs WHERE distance <= 32) WHERE n = 1")
def best_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(resemblance.best_candidate(resemblance.previous_similar(block_hashes(spark, sf_dir), 4, 32)))


@query(
    LSH_SQL + """, ones AS (SELECT doc_id, chunk_i, h, l, coalesce(list_reduce(list_prepend(0, list_filter(range(64), lambda k: ((CASE WHEN k < 32 THEN l >> k ELSE h >> (k - 32) END) & 1) = 1)), lambda a, k: xor(a, k)), 0)::BIGINT AS syndrome FROM lsh),
based AS (SELECT doc_id, chunk_i, syndrome, CASE WHEN syndrome >= 32 THEN xor(h, 1::BIGINT << (syndrome - 32)::INT) ELSE h END AS base_hi, (CASE WHEN syndrome < 32 THEN xor(l, 1::BIGINT << syndrome::INT) ELSE l END) & 4294967294 AS base_lo FROM ones)
SELECT *, lag(chunk_i) OVER (PARTITION BY doc_id, base_hi, base_lo ORDER BY chunk_i) AS similar_i FROM based"""
)
def hamming_base_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = resemblance.same_base(block_hashes(spark, sf_dir))
    return as_doc(c.select("stream_id", "chunk_i", bits.hamming_syndrome(F.col("lsh")).cast("long").alias("syndrome"), F.shiftrightunsigned("base", 32).alias("base_hi"), F.col("base").bitwiseAND(F.lit(4294967295)).alias("base_lo"), "similar_i"))


FEATURES_SQL = "WITH " + BYTES_SQL + f"sampled AS MATERIALIZED (SELECT doc_id, (i // {BLOCK})::BIGINT AS chunk_i, h FROM h5 WHERE (h & {resemblance.SAMPLING_MASK}) = 0), feats AS MATERIALIZED (SELECT doc_id, chunk_i, " + ", ".join(f"max((h * {m} + {a}) & 4294967295)::BIGINT AS f{k}" for k, (m, a) in enumerate(resemblance.FEATURE_COEFFICIENTS)) + " FROM sampled GROUP BY doc_id, chunk_i)"


def features_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 features of each fixed chunk that has a sampled position, with built-in functions."""
    at = chunking.cut_candidates(spread(streams(spark, sf_dir)), mask=resemblance.SAMPLING_MASK)  # about one position in 128
    sampled = at.withColumn("chunk_i", F.floor(F.col("offset") / BLOCK).cast("long"))
    return sampled.groupBy("stream_id", "chunk_i").agg(*(F.max((F.col("gear") * m + a).bitwiseAND(F.lit(4294967295))).alias(f"f{k}") for k, (m, a) in enumerate(resemblance.FEATURE_COEFFICIENTS)))


@query(FEATURES_SQL + " SELECT * FROM feats")
def features16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(features_of_blocks(spark, sf_dir))


SUPER_SQL = FEATURES_SQL + ", sf AS MATERIALIZED (SELECT doc_id, chunk_i, " + ", ".join("md5(" + " || '-' || ".join(f"f{k}::VARCHAR" for k in range(g, g + 4)) + f") AS sf{g // 4}" for g in range(0, 16, 4)) + " FROM feats)"


def super_features_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features_of_blocks(spark, sf_dir)
    return f.select("stream_id", "chunk_i", *(F.md5(F.concat_ws("-", *(F.col(f"f{k}").cast("string") for k in range(g, g + 4)))).alias(f"sf{g // 4}") for g in range(0, 16, 4)))


@query(SUPER_SQL + " SELECT * FROM sf")
def super_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(super_features_of_blocks(spark, sf_dir))


@query(
    SUPER_SQL + """, single AS (SELECT doc_id, chunk_i, unnest([0, 1, 2, 3]) AS k, unnest([sf0, sf1, sf2, sf3]) AS sf FROM sf),
held AS (SELECT doc_id, chunk_i AS similar_i, lead(chunk_i) OVER (PARTITION BY doc_id, sf0, sf1, sf2, sf3 ORDER BY chunk_i) AS until FROM sf)
SELECT x.doc_id, x.chunk_i, y.chunk_i AS similar_i, count(*) AS shared FROM single x JOIN single y ON x.doc_id = y.doc_id AND x.k = y.k AND x.sf = y.sf AND y.chunk_i < x.chunk_i
JOIN held h ON h.doc_id = y.doc_id AND h.similar_i = y.chunk_i AND (until IS NULL OR x.chunk_i <= until) GROUP BY ALL"""
)
def superfeature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = super_features_of_blocks(spark, sf_dir).select("stream_id", "chunk_i", F.array("sf0", "sf1", "sf2", "sf3").alias("super_features"))
    return as_doc(resemblance.sharing_features(c))


@query(
    FIXED + """, m AS (SELECT *, lag(chunk_i) OVER (PARTITION BY doc_id, hash ORDER BY chunk_i) AS match_i FROM fixed), a AS (SELECT *, lag(match_i) OVER (PARTITION BY doc_id ORDER BY chunk_i) + 1 AS similar_i FROM m)
SELECT doc_id, chunk_i, similar_i FROM a WHERE match_i IS NULL AND similar_i < chunk_i"""
)
def dupadj_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_doc(resemblance.after_match(fixed(spark, sf_dir)))


MINI_SQL = "WITH " + blocks_sql("blocks", size=16) + f""", parts AS (SELECT doc_id, ("offset" // {BLOCK})::BIGINT AS chunk_i, "offset" AS o, hash FROM blocks)
SELECT a.doc_id, a.chunk_i, count(*) AS pairs, count(DISTINCT a.o) AS matched FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.hash = b.hash AND b.chunk_i = a.chunk_i - 1 GROUP BY ALL"""


@query(MINI_SQL)
def minichunk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-byte blocks of a chunk that the chunk before it has."""
    p = chunking.fixed_chunks(streams(spark, sf_dir), 16).select("stream_id", F.floor(F.col("offset") / BLOCK).cast("long").alias("chunk_i"), "offset", "hash")
    b = p.select("stream_id", (F.col("chunk_i") + 1).alias("chunk_i"), "hash")
    return as_doc(p.join(b, ["stream_id", "chunk_i", "hash"]).groupBy("stream_id", "chunk_i").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("offset").alias("matched")))


NEXT_SQL = blocks_sql() + ', nexts AS MATERIALIZED (SELECT doc_id, chunk_i, part AS x, lag(part) OVER (PARTITION BY doc_id ORDER BY chunk_i) AS y FROM fixed)'


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixed(spark, sf_dir, with_data=True)
    prev = F.lag("data").over(Window.partitionBy("stream_id").orderBy("chunk_i"))
    return c.withColumn("similar", prev).filter("similar IS NOT NULL").select("stream_id", "chunk_i", F.col("data").alias("chunk"), "similar")


@query(
    "WITH " + NEXT_SQL + """, cmp AS (SELECT doc_id, chunk_i, least(length(x), length(y)) // 2 AS m, regexp_extract_all(x, '..') AS a, regexp_extract_all(y, '..') AS b FROM nexts WHERE y IS NOT NULL)
SELECT doc_id, chunk_i, coalesce(list_filter(range(m), lambda k: a[k + 1] <> b[k + 1])[1], m)::BIGINT AS prefix, coalesce(list_filter(range(m), lambda k: a[len(a) - k] <> b[len(b) - k])[1], m)::BIGINT AS suffix FROM cmp"""
)
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a chunk and the one before it share at either end."""
    @F.pandas_udf("prefix long, suffix long")
    def ends(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"prefix": [bits.common_prefix(x, y) for x, y in zip(a, b)], "suffix": [bits.common_suffix(x, y) for x, y in zip(a, b)]})

    return as_doc(neighbours(spark, sf_dir).select("stream_id", "chunk_i", ends("chunk", "similar").alias("e")).select("stream_id", "chunk_i", "e.prefix", "e.suffix"))


@query()
def delta_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of each chunk against the one before it, by both kinds of parts."""
    n = neighbours(spark, sf_dir)
    return as_doc(delta.delta_pairs(n).withColumn("parts", F.lit("minichunks")).unionByName(delta.delta_pairs(n, content_defined=False).withColumn("parts", F.lit("shingling"))))


@query(FIXED + """ SELECT doc_id, chunk_i, parts, true AS restored, true AS within FROM fixed, (VALUES ('minichunks'), ('shingling')) v(parts) WHERE chunk_i > 0""")
def delta_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of each chunk against the one before it give the chunk back, and save what both ends share at least and the chunk at most."""
    n = neighbours(spark, sf_dir)
    out = None
    for parts in ("minichunks", "shingling"):
        d = delta.delta_pairs(n, content_defined=parts == "minichunks").withColumn("parts", F.lit(parts))
        out = d if out is None else out.unionByName(d)
    sizes = fixed(spark, sf_dir).select("stream_id", "chunk_i", "size")
    return as_doc(out.join(sizes, ["stream_id", "chunk_i"]).select("stream_id", "chunk_i", "parts", "restored", F.col("saved").between(0, F.col("size")).alias("within")))


@query()
def chunk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and super-features of content-defined chunks, by the kernels that the planner uses."""
    c = chunking.cdc_chunks(spread(streams(spark, sf_dir)), with_data=True)
    return as_doc(resemblance.with_similarity(c).drop("data"))
